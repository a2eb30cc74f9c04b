"""Token ids of whole texts, by the tokenizers library, which sees each word of a block once.

Both tokenizers split a text before their merges, and never join characters across a single space or
line break, nor letters with the punctuation behind them, so the ids of a text are those of its words in
turn. A block of texts is cut into words in Arrow, its distinct words are encoded, and their ids are laid
out in the order of the texts. Distinct words of Latin letters with at most punctuation behind them are told apart by
Arrow too, and their letters go many to a call, past normalizing and splitting, which leave them as they
are; a bounded table of them is kept for the next blocks. Other words are encoded one by one, or in runs cut
at word edges. A byte-level text with runs of white space is cut only at single spaces between other characters.
Tests compare with one call for the whole text.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.common import give_back

CACHE_WORDS = 400_000
BLOCK_CHARS = 4 << 20
RUN_WORDS = 512
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ENDINGS = ".,;:!?%&$#*"
#: Letters that are their own composed form and whose lower case is one letter (all up to U+024F but U+0130).
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: The characters by which a byte-level vocabulary writes the bytes of such letters.
_BYTE_CHARS = np.arange(256, dtype="<u4")
_BYTE_CHARS[[*range(128, 161), 173]] = range(290, 324)
_SIMPLE = rf"\A(?P<root>\n?[{_LATIN}]+)(?P<ending>[{re.escape(_ENDINGS)}]*)\z"

Runs = tuple[np.ndarray, np.ndarray]  # ids of many words one after another, and how many each word has


def _take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + length]`` one after another."""
    ends = np.cumsum(lengths)
    at = np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def _runs(found: list[bytes]) -> Runs:
    return np.frombuffer(b"".join(found), "<u4"), np.array([len(b) // 4 for b in found], dtype=np.int64)


def _together(*runs: Runs) -> Runs:
    return np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])


class _Roots:
    """Ids of words of Latin letters, the last CACHE_WORDS new ones kept in Arrow; a word at the begin of a line has its line break."""

    def __init__(self, encoder: "TextEncoder"):
        self.encoder = encoder
        self.known = pa.array([], pa.string())
        self.ids, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where among them the ids of each of the (distinct) words begin and how many they are."""
        place = pc.index_in(words, value_set=self.known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        fresh = words.filter(pa.array(new))
        ids, lengths = self.encoder.roots(fresh)
        known = pa.concat_arrays([fresh, self.known])
        ids, lengths = _together((ids, lengths), (self.ids, self.lengths))
        place += len(fresh)
        place[new] = np.arange(len(fresh))
        self.known, self.lengths = known[:CACHE_WORDS], lengths[:CACHE_WORDS]
        self.ids = ids[: int(self.lengths.sum())]
        return ids, (np.cumsum(lengths) - lengths)[place], lengths[place]


class TextEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.drops_space = self.tokenizer.normalizer is not None
        self.line_break = self.direct(["\n"])[0]
        # Ids that end a word, or begin one behind a space.
        vocabulary = self.tokenizer.get_vocab()
        self.edges = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.edges[i] = token.endswith("</w>") if self.drops_space else token.startswith("Ġ")
        # The same merges for words that need no normalizing and no splitting but at spaces.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.marks = self.edges.copy()
        if not self.drops_space:
            self.marks[np.frombuffer(self.line_break, "<u4")[0]] = True
        self.latin = _Roots(self)

    def direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def roots(self, words: pa.Array) -> Runs:
        """Ids of words of Latin letters, of those with a line break in front with that of the line break."""
        words, texts = words.to_pylist(), []
        for i in range(0, len(words), RUN_WORDS):
            text = " " + " ".join(words[i : i + RUN_WORDS])
            if not text.isascii():
                text = _BYTE_CHARS[np.frombuffer(text.encode(), "u1")].tobytes().decode("utf-32-le")
            texts.append(text if self.drops_space else text.replace(" ", " Ġ").replace("Ġ\n", "Ċ "))
        found = [np.array(e.ids, dtype="<u4") for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        marks = np.flatnonzero(self.marks[ids])
        lengths = np.diff(marks, prepend=-1) if self.drops_space else np.diff(marks, append=len(ids))
        return (ids, lengths) if len(lengths) == len(words) else _runs(self.other(words))

    def words(self, words: list[str], prefix: str) -> list[bytes]:
        """Ids of each word behind ``prefix``, with many words to a call where the ids tell them apart again."""
        found: dict[str, bytes] = {}
        if self.drops_space:
            joined = [w for w in words if w.isalpha()]  # one piece each, so one id that ends a word
        else:
            joined = [w for w in words if w] if prefix else []
        runs = [joined[i : i + RUN_WORDS] for i in range(0, len(joined), RUN_WORDS)]
        texts = [prefix + " ".join(run) for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []):
            ids = np.array(e.ids, dtype="<u4")
            edges = np.flatnonzero(self.edges[ids])
            cuts = [0, *(4 * (edges + 1)).tolist()] if self.drops_space else [*(4 * edges).tolist(), 4 * len(ids)]
            if len(edges) == len(run) and cuts[0] == 0 and cuts[-1] == 4 * len(ids):
                data = ids.tobytes()
                found.update(zip(run, [data[i:j] for i, j in zip(cuts, cuts[1:])]))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self.direct([prefix + w if w else "" for w in rest])))
        return [found[w] for w in words]

    def other(self, words: list[str]) -> list[bytes | None]:
        """Ids of any words, those of the line break included; None for one with white space at a cut."""
        if self.drops_space:
            return self._behind(words, "")
        first = [w[1:] for w in words if w.startswith("\n")]
        later = [w for w in words if not w.startswith("\n")]
        found = {"\n" + w: b and self.line_break + b for w, b in zip(first, self._behind(first, ""))}
        found.update(zip(later, self._behind(later, " ")))
        return [found[w] for w in words]

    def _behind(self, words: list[str], prefix: str) -> list[bytes | None]:
        # A word with an ending is its root's ids and the ending's.
        asked: list[tuple[str, str] | None] = []
        for word in words:
            if not self.drops_space and (not word or word.strip() != word):
                asked.append(None)
            elif word and word[-1] in _ENDINGS and (root := word.rstrip(_ENDINGS)) and root[-1].lower()[-1].isalpha():
                asked.append((root, word[len(root) :]))
            else:
                asked.append((word, ""))
        roots = list(dict.fromkeys(a[0] for a in asked if a))
        endings = list(dict.fromkeys(a[1] for a in asked if a))
        of_root, of_ending = dict(zip(roots, self.words(roots, prefix))), dict(zip(endings, self.direct(endings)))
        return [a and of_root[a[0]] + of_ending[a[1]] for a in asked]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return list(self.encode(pa.array(texts, pa.string())))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, block by block; a null text is an empty one."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS)) + 1
            yield from self._block(texts[at:to].cast(pa.string()))
            give_back()
            at = to

    def _block(self, texts: pa.Array) -> list[bytes]:
        if self.drops_space:
            marked, extra = pc.replace_substring(texts, "\n", " "), 0
        else:
            # The first word of a line keeps the line break. The text gets one too, which is left out at the end.
            marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
            extra = len(self.line_break) // 4
        cut = pc.split_pattern(marked, " ")
        words = cut.flatten().dictionary_encode()
        ids, lengths, unsafe = self._distinct(words.dictionary)
        starts = np.cumsum(lengths) - lengths
        which = words.indices.to_numpy()
        of_text = cut.value_lengths().to_numpy().astype(np.int64)
        until = np.cumsum(of_text)
        places = np.concatenate([[0], np.cumsum(lengths[which])])
        del marked, cut, words
        begin, end = places[until - of_text], places[until]
        del places
        ids = _take(ids, starts[which], lengths[which]).tobytes()
        out = [ids[4 * (i + extra) : 4 * j] for i, j in zip(begin.tolist(), end.tolist())]
        for k in np.flatnonzero(np.bincount(np.repeat(np.arange(len(out)), of_text), unsafe[which], len(out))):
            head, *tail = _SINGLE_SPACE.split(texts[int(k)].as_py())
            out[k] = b"".join(self.direct([head, *[" " + piece for piece in tail]]))
        return out

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct words one after another, how many each has, and whether it has white space at a cut."""
        split = pc.extract_regex(words, _SIMPLE)
        simple = split.is_valid()
        split = split.filter(simple)
        roots = pc.struct_field(split, "root")
        roots = (pc.utf8_lower(roots) if self.drops_space else roots).dictionary_encode()
        endings = pc.struct_field(split, "ending").dictionary_encode()
        found = self.other(words.filter(pc.invert(simple)).to_pylist())
        ids, first, n_first = self.latin.of(roots.dictionary)
        behind, n_behind = _runs(self.direct(endings.dictionary.to_pylist()))
        rest, n_rest = _runs([f or b"" for f in found])
        # Two runs a word: its root and its ending, or all of it and nothing.
        starts, lengths = np.zeros((2, len(words), 2), dtype=np.int64)
        simple = simple.to_numpy(zero_copy_only=False)
        root, ending = roots.indices.to_numpy(), endings.indices.to_numpy()
        starts[simple] = np.stack([first[root], (len(ids) + np.cumsum(n_behind) - n_behind)[ending]], axis=1)
        lengths[simple] = np.stack([n_first[root], n_behind[ending]], axis=1)
        starts[~simple, 0] = len(ids) + len(behind) + np.cumsum(n_rest) - n_rest
        lengths[~simple, 0] = n_rest
        unsafe = np.zeros(len(words))
        unsafe[~simple] = [f is None for f in found]
        return _take(np.concatenate([ids, behind, rest]), starts.ravel(), lengths.ravel()), lengths.sum(axis=1), unsafe


def text_encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, so that its tokenizer and its known words outlive a task."""
    kept = sys.__dict__.setdefault("_text_encoders", {})
    if path not in kept:
        kept[path] = TextEncoder(path)
    return kept[path]
