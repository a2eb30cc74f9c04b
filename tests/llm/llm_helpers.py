"""Values and texts that the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF_DIR = "/root/testdata/sf0.001"


def words(n, seed, prefix="w"):
    rng = random.Random(seed)
    return [f"{prefix}{rng.randrange(5000)}" for _ in range(n)]
