"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector of its tag path (hashed element names and class
or id words), its hashed words, and a few numbers (length, links, place). A bidirectional LSTM in numpy
reads the whole sequence both ways and gives every block a probability of being main text, so a block is
judged by the document around it.

It is trained here, on the driver, on a bounded sample: the ``SAMPLE_PAGES`` pages with the smallest hash of
their page_id among those of at most ``SAMPLE_CHARS`` characters that mark their article themselves, from which
the labels come. So that the labeller does not depend on that mark, training shows each page also in
altered forms: other names for the article and the parts around it, or none, and added headers, sidebars,
notices, adverts, forms and reader comments whose words come from other pages.

Defined cases: a null or empty page has an empty text; a page without tags is one block; repeated rows and
null ids are rows like any other; without pages that mark an article nothing is learned, and the text is all
blocks outside the elements that never hold an article; whole pages are read, however long; a column of the
pages that is named as the result is left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.htmlblocks import Block, blocks_of

SAMPLE_PAGES = 384
SAMPLE_CHARS = 1 << 15
PATH_SLOTS, WORD_SLOTS = 1024, 4096
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 16, 8, 6, 16
EPOCHS, BATCH, RATE = 4, 24, 0.01

# Names of page parts, for the labels of pages that mark their article and for the altered forms.
ARTICLE = [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("post", "body")), ("div", ("entry", "content")), ("div", ("article", "body")), ("section", ("story",)), ("div", ("text",)), ("td", ()), ("div", ()), None]
AROUND = {
    "nav": [("nav", ()), ("div", ("menu",)), ("div", ("navbar",)), ("ul", ("nav",)), ("div", ("breadcrumb",)), ("div", ("navigation",))],
    "header": [("header", ()), ("div", ("header",)), ("div", ("masthead",)), ("div", ("top", "bar"))],
    "footer": [("footer", ()), ("div", ("footer",)), ("div", ("site", "footer")), ("div", ("copyright",))],
    "aside": [("aside", ()), ("div", ("sidebar",)), ("div", ("related",)), ("div", ("widget",)), ("section", ("recommended",))],
    "ad": [("div", ("ad",)), ("div", ("advert",)), ("div", ("ads",)), ("aside", ("sponsored",)), ("div", ("promo",)), ("div", ("banner",))],
    "notice": [("div", ("cookie", "notice")), ("div", ("consent",)), ("div", ("alert",)), ("section", ("notice",)), ("div", ("popup",)), ("div", ("newsletter",))],
    "form": [("form", ()), ("form", ("search",)), ("form", ("login",)), ("form", ("subscribe",))],
    "comments": [("section", ("comments",)), ("div", ("comment",)), ("ol", ("comment", "list")), ("div", ("comments", "area")), ("div", ("disqus",)), ("div", ("replies",))],
    "share": [("div", ("share",)), ("div", ("social",))],
}
_AROUND_TAGS = {t for kind in ("nav", "header", "footer", "aside", "form") for t, _ in AROUND[kind][:1]}
_AROUND_NAMES = {n for parts in AROUND.values() for _, names in parts for n in names} - {"top", "bar", "site", "list", "area"}


def marked(block: Block) -> bool:
    """Whether the page itself says that the block is part of its article."""
    inside = False
    for tag, names in block.path:
        if tag in ("article", "main"):
            inside = True
        elif tag in _AROUND_TAGS or _AROUND_NAMES & set(names):
            return False
    return inside


# Vectors


class Vectors:
    """Numbers of the hashed tokens of blocks."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def word(self, w: str) -> int:
        found = self.words.get(w)
        if found is None:
            if len(self.words) > 200_000:
                self.words.clear()
            found = self.words[w] = zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_SLOTS
        return found

    def page(self, blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        paths, words, n = [], [], len(blocks)
        numbers = np.zeros((n, NUMBERS), dtype=np.float32)
        for i, b in enumerate(blocks):
            tokens = [f"<{t}>" for t, _ in b.path] + [name for _, names in b.path for name in names]
            tokens.append("leaf " + (b.path[-1][0] if b.path else ""))
            paths.append(np.array([zlib.crc32(t.encode("utf-8", "replace")) % PATH_SLOTS for t in tokens], dtype=np.int64))
            own = b.text.split()
            words.append(np.fromiter(map(self.word, own), np.int64, len(own)))
            numbers[i] = (math.log1p(len(own)) / 5, b.link_share, len(b.path) / 10, i / max(1, n - 1), math.log1p(i) / 5, b.text[-1:] in ".!?")
        return paths, words, numbers


def _mean_rows(table: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(g) for g in groups])
    owner = np.repeat(np.arange(len(groups)), sizes)
    out = np.zeros((len(groups), table.shape[1]), dtype=np.float32)
    if len(owner):
        flat = table[np.concatenate(groups)]
        starts = np.cumsum(sizes) - sizes
        out[sizes > 0] = np.add.reduceat(flat, starts[sizes > 0]) / sizes[sizes > 0, None]
    return out


# The network


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Embeddings, one LSTM in each direction, and a logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + NUMBERS

        def make(*shape):
            return (rng.normal(size=shape) / math.sqrt(shape[0])).astype(np.float32)

        self.p = {"path": make(PATH_SLOTS, PATH_DIM) * 10, "word": make(WORD_SLOTS, WORD_DIM) * 10, "out": make(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"{d}w": make(size + HIDDEN, 4 * HIDDEN), f"{d}b": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"{d}b"][:HIDDEN] = 1.0  # remember at first

    def inputs(self, pages) -> tuple[np.ndarray, np.ndarray]:
        """Padded inputs (step, page, feature) and the mask (step, page)."""
        rows = np.concatenate([
            np.concatenate([_mean_rows(self.p["path"], paths), _mean_rows(self.p["word"], words), numbers], axis=1) for paths, words, numbers in pages
        ])
        lengths = np.array([len(n) for _, _, n in pages])
        steps = int(lengths.max())
        x, mask = np.zeros((steps, len(pages), rows.shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32)
        at = 0
        for j, n in enumerate(lengths):
            x[:n, j], mask[:n, j] = rows[at : at + n], 1
            at += n
        return x, mask

    def _run(self, d: str, x, mask, keep: bool):
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        w, b = self.p[f"{d}w"], self.p[f"{d}b"]
        n = x.shape[1]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        given = x @ w[:-HIDDEN] + b
        hidden, tape = np.zeros((len(x), n, HIDDEN), np.float32), []
        for t in steps:
            z = given[t] + h @ w[-HIDDEN:]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * u
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, f, i, o, u, new))
            c = m * new + (1 - m) * c
            h = m * (o * np.tanh(new)) + (1 - m) * h
            hidden[t] = h
        return hidden, tape

    def forward(self, x, mask, keep: bool = False):
        hf, tf = self._run("f", x, mask, keep)
        hb, tb = self._run("b", x, mask, keep)
        both = np.concatenate([hf, hb], axis=2)
        return _sigmoid(both @ self.p["out"] + self.p["bias"])[:, :, 0], both, tf, tb

    def probabilities(self, pages) -> list[np.ndarray]:
        x, mask = self.inputs(pages)
        p = self.forward(x, mask)[0]
        return [p[: len(n), j] for j, (_, _, n) in enumerate(pages)]

    def gradients(self, pages, labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        x, mask = self.inputs(pages)
        p, both, tf, tb = self.forward(x, mask, keep=True)
        y = np.zeros_like(p)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        dz = ((p - y) * mask / n)[:, :, None]
        g = {"out": np.einsum("tbh,tbo->ho", both, dz), "bias": dz.sum(axis=(0, 1))}
        dboth = dz @ self.p["out"].T
        dx = np.zeros_like(x)
        for d, tape, dh_all in (("f", tf, dboth[:, :, :HIDDEN]), ("b", tb, dboth[:, :, HIDDEN:])):
            w = self.p[f"{d}w"]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros(dh_all.shape[1:], np.float32), np.zeros(dh_all.shape[1:], np.float32)
            for t, h, c, f, i, o, u, new in reversed(tape):
                m = mask[t][:, None]
                dh = dh + dh_all[t]
                tanh = np.tanh(new)
                dnew = m * (dh * o * (1 - tanh * tanh) + dc)
                do = m * dh * tanh
                dzt = np.concatenate([dnew * c * f * (1 - f), dnew * u * i * (1 - i), do * o * (1 - o), dnew * i * (1 - u * u)], axis=1)
                gw[:-HIDDEN] += x[t].T @ dzt
                gw[-HIDDEN:] += h.T @ dzt
                gb += dzt.sum(axis=0)
                dx[t] += dzt @ w[:-HIDDEN].T
                dh = dzt @ w[-HIDDEN:].T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            g[f"{d}w"], g[f"{d}b"] = gw, gb
        for key, a, b, k in (("path", 0, PATH_DIM, 0), ("word", PATH_DIM, PATH_DIM + WORD_DIM, 1)):
            table = np.zeros_like(self.p[key])
            for j, page in enumerate(pages):
                for t, ids in enumerate(page[k]):
                    if len(ids):
                        np.add.at(table, ids, dx[t, j, a:b] / len(ids))
            g[key] = table
        return loss, g

    def train(self, pages, labels, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> float:
        """Adam over pages of similar length; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        order = sorted(range(len(pages)), key=lambda i: len(labels[i]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        step, mean = 0, math.inf
        for _ in range(epochs):
            losses = []
            for k in rng.permutation(len(batches)):
                loss, g = self.gradients([pages[i] for i in batches[k]], [labels[i] for i in batches[k]])
                losses.append(loss)
                step += 1
                for key, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    m[key] = 0.9 * m[key] + 0.1 * grad
                    v[key] = 0.999 * v[key] + 0.001 * grad * grad
                    self.p[key] = (self.p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean


# Training pages


def altered(blocks: list[Block], pool: list[str], rng: np.random.Generator) -> list[Block]:
    """The page under other names, with other parts around and inside its article."""
    main = ARTICLE[rng.integers(len(ARTICLE))]
    names = {kind: parts[rng.integers(len(parts))] for kind, parts in AROUND.items()}

    def renamed(path):
        out = []
        for tag, own in path:
            if tag in ("article", "main"):
                out += [main] if main else []
            elif tag in ("nav", "footer", "header", "aside", "form"):
                out.append(names[tag])
            else:
                out.append(next((names[kind] for kind, parts in AROUND.items() if own and (tag, own) in parts), (tag, own)))
        return out

    page = [Block(renamed(b.path), b.text, b.link_share, b.label) for b in blocks]
    body = [("html", ()), ("body", ())]

    def snippet(low, high):
        words = pool[rng.integers(len(pool))].split()
        n = int(rng.integers(low, high + 1))
        at = int(rng.integers(max(1, len(words) - n)))
        return " ".join(words[at : at + n])

    def part(kind, inner, count, low, high, links):
        return [Block([*body, *inside, names[kind], *inner], snippet(low, high), links, 0) for _ in range(count)]

    first = next((i for i, b in enumerate(page) if b.label), len(page))
    last = max((i for i, b in enumerate(page) if b.label), default=-1) + 1
    out = list(page)
    wrap = [main] if main and rng.random() < 0.5 else []
    inside = wrap
    after: list[Block] = []
    if rng.random() < 0.6:
        after += part("comments", [("p", ())] if rng.random() < 0.7 else [], int(rng.integers(1, 8)), 3, 60, 0.0)
    if rng.random() < 0.3:
        after += part("share", [], 1, 1, 4, 1.0)
    if rng.random() < 0.5:
        inside = []
        after += part("aside", [("ul", ()), ("li", ())] if rng.random() < 0.6 else [("p", ())], int(rng.integers(1, 9)), 1, 30, float(rng.random() < 0.7))
    if rng.random() < 0.4:
        inside = []
        after += part("form", [("div", ())] if rng.random() < 0.5 else [], int(rng.integers(1, 4)), 1, 12, 0.0)
    out[last:last] = after
    if last - first > 2:
        for kind, low, high in (("ad", 2, 30), ("notice", 3, 30), ("aside", 2, 20), ("form", 2, 8)):
            if rng.random() < 0.3:
                inside = wrap if rng.random() < 0.7 else []
                at = int(rng.integers(first + 1, last))
                out[at:at] = part(kind, [("p", ())] if rng.random() < 0.5 else [], int(rng.integers(1, 3)), low, high, float(rng.random() < 0.3))
    inside, before = [], []
    for kind, chance, low, high in (("notice", 0.4, 5, 40), ("header", 0.5, 1, 8), ("ad", 0.3, 3, 25)):
        if rng.random() < chance:
            before += part(kind, [("p", ())] if rng.random() < 0.4 else [], int(rng.integers(1, 3)), low, high, float(rng.random() < 0.4))
    return before + out


def _marking(batches):
    """Keys of the pages with a block that they mark as article."""
    for batch in batches:
        own = [any(map(marked, blocks_of(p))) for p in batch.column(2).to_pylist()]
        yield batch.select(["page_id", "drawn"]).filter(pa.array(own, pa.bool_()))


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, forms: int = 3) -> BlockLabeller | None:
    """A labeller trained on the sample; None if no page of at most ``SAMPLE_CHARS`` characters marks an article."""
    small = pages.select("page_id", "html").filter(F.char_length("html").between(1, SAMPLE_CHARS))
    # The tag is looked for first, so that only pages that may mark an article are parsed.
    small = small.filter(F.col("html").rlike("(?i)<(article|main)[\\s/>]"))
    small = small.select("page_id", F.xxhash64("page_id", "html").alias("drawn"), "html")
    # Keys are drawn, so that no task sends pages to the driver but those of the sample.
    drawn = small.mapInArrow(_marking, small.drop("html").schema).dropDuplicates().orderBy("drawn").limit(sample_pages)
    keys = F.broadcast(pages.sparkSession.createDataFrame(drawn.collect(), drawn.schema).withColumnsRenamed({"page_id": "__page", "drawn": "__drawn"}))
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("drawn") == F.col("__drawn"))
    sample = small.join(keys, same, "left_semi").dropDuplicates(["page_id", "drawn"]).collect()
    sample.sort(key=lambda r: r["drawn"])
    known = []
    for row in sample:
        blocks = blocks_of(row["html"])
        for b in blocks:
            b.label = int(marked(b))
        known.append(blocks)
    if not known:
        return None
    rng = np.random.default_rng(5)
    pool = [b.text for blocks in known for b in blocks if b.label] or ["text"]
    shown = [b for blocks in known for b in (blocks, *(altered(blocks, pool, rng) for _ in range(forms)))]
    vectors = Vectors()
    labeller = BlockLabeller()
    labeller.train([vectors.page(b) for b in shown], [np.array([x.label for x in b], np.float32) for b in shown])
    return labeller


def main_texts(pages: list[str | None], labeller: BlockLabeller | None, vectors: Vectors, group: int = 64) -> list[str]:
    """The joined main blocks of each page."""
    blocks = [blocks_of(p or "") for p in pages]
    out = [""] * len(pages)
    full = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    for a in range(0, len(full), group):
        own = full[a : a + group]
        if labeller is None:
            chosen = [[not any(t in _AROUND_TAGS for t, _ in b.path) for b in blocks[i]] for i in own]
        else:
            chosen = [p >= 0.5 for p in labeller.probabilities([vectors.page(blocks[i]) for i in own])]
        for i, keep in zip(own, chosen):
            out[i] = " ".join(b.text for b, k in zip(blocks[i], keep) if k)
    return out


def extract(pages: DataFrame, labeller: BlockLabeller | None, result: str = "text") -> DataFrame:
    """``pages`` (with a column ``html``) with the main text."""
    pages = pages.select([c for c in pages.columns if c != result])
    where = pages.columns.index("html")
    schema = StructType([*pages.schema.fields, *StructType.fromDDL(f"`{result}` string").fields])
    weights = None if labeller is None else labeller.p
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # fixed size
    name = uuid.uuid4().hex

    def run(batches):
        kept = sys.__dict__.setdefault("_block_labeller", {})
        if name not in kept:
            kept.clear()
            model = None
            if shared.value is not None:
                model = BlockLabeller()
                model.p = shared.value
            kept[name] = model, Vectors()
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(main_texts(part.column(where).to_pylist(), *kept[name]), pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
