"""What the banded search of the pipeline's near-duplicate stage finds, and how many pairs it makes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import near_dedup


def _met(docs):
    rows = near_dedup.sketches(docs).withColumn("node", F.col("doc_id"))
    met = near_dedup.meetings(rows)
    return met.alias("x").join(met.alias("y"), "key").filter("x.node < y.node").select("x.node", F.col("y.node").alias("b"))


def test_recall_on_edited_and_boilerplate_texts(docs_of):
    """Pairs at 0.80 to 0.90: appended, cut, replaced, or in a frame that many texts share."""
    random = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in random.integers(0, 10**6, n)]
    frame, rows = fresh(120), []
    for i in range(200):
        similarity = 0.80 + 0.10 * (i % 5) / 4
        text = fresh(204) if i % 4 < 3 else frame + fresh(84)
        part = round(204 * (1 - similarity))
        block = round(200 * (1 - similarity) / (1 + similarity)) - 4
        edited = [
            text + fresh(int(200 / similarity) - 200), text[: 204 - part],
            text[:90] + fresh(block) + text[90 + block :], text[:130] + fresh(block) + text[130 + block :],
        ][i % 4]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited))]
    sets = [{tuple(x) for x in near_dedup.shingle_set(t.encode(), 5).tolist()} for _, t in rows]
    similar = {2 * i for i in range(200) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    found = {r.node for r in _met(docs_of(*rows)).collect() if r.node in similar and r.b == r.node + 1}
    assert len(similar) > 150 and len(found) >= 0.99 * len(similar)


@pytest.mark.parametrize("places", [256])
def test_agreement_estimates_the_similarity(places):
    random = np.random.default_rng(2)
    shared, own = (random.integers(0, 2**63, 4000).astype(np.uint64) for _ in range(2))
    orders = near_dedup._orders(places)
    left, right = (near_dedup.minima(np.unique(np.concatenate((shared[:3000], o))), orders) for o in (own[:500], own[500:1000]))
    assert abs((left == right).mean() - 0.75) < 0.1
    assert (near_dedup.minima(np.zeros(0, dtype=np.uint64), orders) == np.iinfo(np.uint64).max).all()
