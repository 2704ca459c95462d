"""Near-duplicates of very short texts, whose sketches borrow most registers."""

import random
import string
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from strandframe.llm import neardup  # noqa: E402


def test_pairs_of_few_words_at_the_threshold(spark):
    """8 random words against their first 7, and 12 against 11 with one shingle more on one side: none may be lost."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9)))
    rows = [(0, "fewnlw waoaf gjtvvio eew keqrn blcokghie qcnlrs lttrxbj"), (1, "fewnlw waoaf gjtvvio eew keqrn blcokghie qcnlrs")]
    for k in range(1, 4000):
        own = [word() for _ in range(8 if k % 4 else 12)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-1]))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    want = brute.near_duplicates(rows)
    assert all(want[2 * k + 1][1] == 2 * k for k in range(4000))
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
