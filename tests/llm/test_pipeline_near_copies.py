"""The pipeline's near-duplicate stage keeps one row of each component of SimHash fingerprints."""

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import components, near_dedup, simhash

SF = "/root/testdata/sf0.001"


def kept_by_force(rows):
    """The smallest id of each group of fingerprints that links within two bits join."""
    prints = {d: simhash.fingerprint((t or "").encode(), 3) % 2**64 for d, t in rows}
    ids, kept, left = sorted(prints), [], set(prints)
    for d in ids:
        if d in left:
            kept.append(d)
            reached = [d]
            left.discard(d)
            while reached:
                at = prints[reached.pop()]
                near = [x for x in left if (prints[x] ^ at).bit_count() <= 2]
                left.difference_update(near)
                reached += near
    return kept


def stage(spark, docs):
    return sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect())


def test_stage_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage(spark, docs) == kept_by_force([(r.doc_id, r.text) for r in docs.collect()])


def crowd(n):
    """Texts that differ from one text in about a tenth of their words."""
    random = np.random.default_rng(5)
    base, rows = [f"w{x}" for x in random.integers(0, 10**6, 130)], []
    for i in range(n):
        words = list(base)
        for at in random.choice(130, random.integers(0, 26), replace=False):
            words[at] = f"n{random.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_stage_takes_links_between_fingerprints_in_a_crowd(spark, docs_of):
    rows = crowd(300)
    kept = kept_by_force(rows)
    assert 1 < len(kept) < 300 and stage(spark, docs_of(*rows)) == kept


def test_links_of_a_crowd_grow_with_its_rows(spark, docs_of):
    """Fingerprints close together: each has all others of a ball as neighbours, but not a link to each."""
    random = np.random.default_rng(9)
    for n in (500, 2000):
        prints = {sum(1 << int(b) for b in random.choice(63, random.integers(0, 4), replace=False)) for _ in range(n)}
        links = simhash.close_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"))
        assert links.count() <= 65 * len(prints)


@pytest.mark.parametrize("copies", (1, 3))
def test_stage_of_odd_rows(spark, docs_of, clashing, copies):
    rows = [(1, None), (0, ""), (None, "  "), (5, "a b c d"), (5, "A  b c d"), (None, "alone here"), (6, "x y")] * copies
    wide = clashing(docs_of(*rows))
    kept = corpus_pipeline.without_near_copies(spark, wide, SF)
    assert kept.columns == wide.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "5", "6", "None"]
    assert corpus_pipeline.without_near_copies(spark, wide.limit(0), SF).count() == 0


def test_tables_of_the_stage_are_no_multiple_of_a_crowd(spark, docs_of, monkeypatch):
    """Texts with one frame and words of their own: no table that the stage writes has rows for all who meet, or pairs."""
    random, written = np.random.default_rng(4), []
    fresh = lambda n: [f"w{x}" for x in random.integers(0, 10**6, n)]
    frame = fresh(120)
    rows = [(i, " ".join(frame + fresh(30))) for i in range(600)]
    for module in (simhash, components, near_dedup):
        def counting(df, name, write=module.stored):
            table = write(df, name)
            written.append((table.count(), name))
            return table

        monkeypatch.setattr(module, "stored", counting)
    corpus_pipeline.without_near_copies(spark, docs_of(*rows), SF).count()
    assert written and max(written)[0] <= 2 * 600, max(written)
