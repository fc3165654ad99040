"""Token counts, centroid clustering and tokenizer alignment against the libraries and brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, centroids, token_counts
from ledgerloom.llm.vocabularies import default_path, read_vocabulary, vocabulary

SF = "/root/testdata/sf0.001"
PIECES, BYTES = default_path("piece_bpe_32k.model"), default_path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "\n", "\n ", " \n", "a  b", "a\n b", "a\n  b\t c", "   x   ", "▁", "a▁b", "<s>a</s><unk>",
    "<|endoftext|> and <s>", "　x   y", "éﬁ Ça 12 3456", "你好 世界\U0001f600 \U0001f600",
    "it's we'll 'd", "x\x00y", "a​ b​  c﻿ d", "z" * 5000, "ab " * 3000, "3.14\r\n\r\n  2", "᠎ ᠎a",
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_level():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


# Pre-tokens

words = st.text(st.sampled_from(" ▁\n\t ​.,'a1éж你Z<|>"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(words)
def test_pre_tokens_encode_like_the_whole_text(text):
    for path, added in ((PIECES, ""), (BYTES, " ")):
        vocab = vocabulary(*read_vocabulary(path))
        parts = list(vocab.split(added + text))
        whole = (
            sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
            if path == PIECES
            else Tokenizer.from_file(path).encode(added + text, add_special_tokens=False).ids
        )
        if "<|endoftext|>" not in text:
            assert [i for ids in vocab.encode(parts) for i in ids] == whole


def test_lazily_cut_texts_are_cut_alike(monkeypatch):
    text = "some words  and\n 12 more " * 50
    for path in (PIECES, BYTES):
        vocab = vocabulary(*read_vocabulary(path))
        parts = list(vocab.split(text))
        with monkeypatch.context() as patch:
            patch.setattr("ledgerloom.llm.vocabularies.LONG", 10)
            assert list(vocab.split(text)) == parts


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="neither"):
        read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with pytest.raises(ValueError, match="byte-level"):
        vocabulary(*read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))


def test_ranks_and_library_give_the_same_ids(documents):
    vocab = vocabulary(*read_vocabulary(BYTES))
    parts = [part for r in documents.collect() for part in vocab.split(" " + r.text)]
    parts += [token.decode() for token in vocab.token_bytes() if token.isascii()]
    assert vocab.encode(parts) == vocab._by_library(parts)


# Token counts


def test_token_counts_are_those_of_the_library(documents, pieces):
    texts = {r.doc_id: r.text for r in documents.collect()}
    found = token_counts.count_tokens(documents, limit=300).collect()
    assert len(found) == documents.count()
    for r in found:
        n = len(pieces.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 300)


@pytest.mark.parametrize("frequent", [1, 50, 1 << 18])
def test_frequent_tokens_change_no_count(documents, frequent):
    counts = sorted(map(tuple, token_counts.count_tokens(documents).collect()))
    assert sorted(map(tuple, token_counts.count_tokens(documents, frequent=frequent).collect())) == counts


def test_frequent_tokens_are_bounded(documents):
    tokens = token_counts.pre_tokens(documents, PIECES).cache()
    for frequent in (1, 7, 100):
        assert len(token_counts.frequent_tokens(tokens, frequent)) <= 2 * frequent


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_token_counts_of_odd_texts(docs_of, clashing, pieces, byte_level, path):
    rows = docs_of(*enumerate(ODD), (3, "twice"), (3, "twice"), (None, "no id"))
    found = Counter(map(tuple, token_counts.count_tokens(clashing(rows), path).collect()))

    def n_tokens(text):
        if path == PIECES:
            return len(pieces.encode(text))
        return len(byte_level.encode(text, add_special_tokens=False).ids)

    expected = [(r.doc_id, r.text or "") for r in rows.collect()]
    expected = [(d, len(t.encode()), n_tokens(t), n_tokens(t) > 4096) for d, t in expected]
    assert found == Counter(expected)


def test_very_long_texts_are_counted_whole(docs_of, pieces):
    text = "lorem 12345  ipsum\n dolor▁ " * 60_000  # above a megabyte
    rows = token_counts.count_tokens(docs_of((1, text), (2, "x" * 200_000))).collect()
    found = {r.doc_id: r.n_tokens for r in rows}
    assert found == {1: len(pieces.encode(text)), 2: len(pieces.encode("x" * 200_000))}


# Centroids


def by_force(vectors, clusters=16, rounds=3):
    """Rows (vec_id, cluster, distance) and the centroids, with plain loops over whole numbers."""
    kept = [
        (i, [int(np.floor(64 * float(x))) for x in v])
        for i, v in vectors
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [x for _, x in first[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(middle)) for _, x in kept]

    for _ in range(rounds):
        mine = assign()
        for k in range(len(middle)):
            own = [x for (_, x), (_, j) in zip(kept, mine, strict=True) if j == k]
            if own:
                middle[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return [(i, k, d) for (i, _), (d, k) in zip(kept, assign(), strict=True)], middle


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def check_report(df, vectors):
    rows, middle = by_force(vectors)
    found = [tuple(r) for r in df.collect()]
    sums = Counter()
    for _, k, d in rows:
        sums[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    expected = [(i, k, d, sums[k], sum(sums.values()), sha[k]) for i, k, d in rows]
    assert Counter(found) == Counter(expected)


def test_clusters_are_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_report(centroids.cluster_report(table), [(r.vec_id, r.embedding) for r in table.collect()])


def test_clusters_of_odd_vectors(spark):
    random = np.random.default_rng(3)
    base = random.normal(0, 0.1, (30, 64)).astype(np.float32).tolist()
    odd = [
        (100, None), (101, []), (102, base[0][:63]), (103, base[0] + [1.0]), (104, [None, *base[0][1:]]),
        (105, [float("nan"), *base[0][1:]]), (106, [float("inf"), *base[0][1:]]), (107, [float("-inf"), *base[0][1:]]),
        (None, base[1]), (5, base[5]), (5, base[6]), (108, [0.0] * 64), (109, [0.0] * 64), (110, [-0.001] * 64),
    ]
    rows = [*enumerate(base), *odd]
    wide = vectors_of(spark, rows).withColumns({n: F.lit("x") for n in ("x", "_x", "cluster", "distance", "name")})
    check_report(centroids.cluster_report(wide.repartition(5)), rows)
    # A component whose distances leave 63 bits is left out like an infinite one.
    assert centroids.cluster_report(vectors_of(spark, [(1, [1e30] + [0.0] * 63)])).count() == 0


def test_clusters_with_few_and_no_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(3)]
    check_report(centroids.cluster_report(vectors_of(spark, same)), same)  # ties go to centroid 0
    empty = centroids.cluster_report(vectors_of(spark, []))
    assert empty.collect() == [] and empty.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    ]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.integers(1, 6), st.integers(0, 5))
def test_threshold_walk_finds_the_nearest(seed, count, dims, spread):
    random = np.random.default_rng(seed)
    middle = random.integers(-spread, spread + 1, (count, dims))  # many ties
    x = random.integers(-spread - 2, spread + 3, (40, dims))
    numbers, distances = centroids.nearest(x, middle)
    exact = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (numbers == exact.argmin(axis=1)).all() and (distances == exact.min(axis=1)).all()


def test_threshold_ends_the_walk_early(monkeypatch):
    """Far clusters are not looked at: the lists are left before their ends."""
    middle = np.repeat(np.arange(64)[:, None] * 100, 8, axis=1)
    x = middle[::3] + 1
    calls = []
    real = np.put_along_axis
    monkeypatch.setattr(np, "put_along_axis", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    numbers, _ = centroids.nearest(x, middle)
    assert (numbers == np.arange(0, 64, 3)).all() and len(calls) <= 2


# Alignment


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_gallop_and_overlaps_are_brute_force(a, b):
    end = 61
    a, b = sorted(a | {end}), sorted(b | {end})
    assert alignment.gallop(a, b) == [sum(y < x for y in b) for x in a]
    found = alignment.align(np.array(a), np.array(b))
    a_at, b_at = [0, *a], [0, *b]
    links = {
        (i, j)
        for i in range(len(a))
        for j in range(len(b))
        if a_at[i] < b_at[j + 1] and b_at[j] < a_at[i + 1]
    }
    pairs = list(zip(found.a_links.tolist(), found.b_links.tolist(), strict=True))
    assert len(pairs) == len(links) and set(pairs) == links
    common = sorted(set(a) & set(b))
    assert found.a_cuts.tolist() == [a.index(c) + 1 for c in common]
    assert found.b_cuts.tolist() == [b.index(c) + 1 for c in common]


def test_gallop_skips_most_of_a_long_list():
    class Counted(list):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return super().__getitem__(at)

    assert alignment.gallop([99_000], Counted(range(100_000))) == [99_000]
    assert Counted.reads < 40


def aligned_by_force(rows, byte_level, pieces):
    """Per row the columns of the report but doc_id, by a merge of both lists of tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

    def a_bytes(i):
        return bytes(byte[c] for c in byte_level.id_to_token(i))

    def b_bytes(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    found, total = [], Counter()
    for text in rows:
        a = byte_level.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_parts, b_parts = list(map(a_bytes, a)), list(map(b_bytes, b))
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            found.append(None)
            continue
        a_ends, b_ends = np.cumsum(list(map(len, a_parts))).tolist(), np.cumsum(list(map(len, b_parts))).tolist()
        links, groups, i, j, left = [], [], 0, 0, ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = a_ends[i], b_ends[j]
            if x <= y:
                left[0].append(str(a[i]))
                i += 1
            if y <= x:
                left[1].append(str(b[j]))
                j += 1
            if x == y:
                groups.append("|".join(map(",".join, left)))
                left = ([], [])
        total.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if one is None
        else (*one[:3], len(one[3]), sum(total[p] == most[p[1]] for p in one[3]), sum(total[p] for p in one[3]), one[4])
        for one in found
    ]


def test_alignment_is_brute_force(documents, byte_level, pieces):
    rows = documents.collect()
    expected = aligned_by_force([r.text for r in rows], byte_level, pieces)
    found = [tuple(r) for r in alignment.align_documents(documents).collect()]
    assert sorted(found) == sorted((r.doc_id, *e) for r, e in zip(rows, expected, strict=True))


@pytest.mark.parametrize("frequent", [1, 30, 1 << 18])
def test_alignment_of_odd_texts(docs_of, clashing, byte_level, pieces, frequent):
    rows = docs_of(*enumerate(ODD), (3, "twice  over"), (3, "twice  over"), (None, "no id"))
    texts = rows.collect()
    expected = aligned_by_force([r.text for r in texts], byte_level, pieces)
    found = alignment.align_documents(clashing(rows), frequent=frequent).collect()
    assert Counter(map(tuple, found)) == Counter((r.doc_id, *e) for r, e in zip(texts, expected, strict=True))


def test_groups_hold_the_ids_in_order(docs_of, byte_level, pieces):
    text = "Unfortunately, antidisestablishmentarianism\n 2024!"
    row = alignment.alignments(docs_of((1, text))).first()
    groups = [g.split("|") for g in row.groups.split(";")]
    a, b = ([int(i) for g in groups for i in g[side].split(",")] for side in (0, 1))
    assert a == byte_level.encode(" " + text, add_special_tokens=False).ids and b == pieces.encode(text)
    assert len(groups) == row.n_groups and sum(row.times) == row.n_links == row.n_a + row.n_b - row.n_groups


def test_empty_tables(docs_of):
    empty = docs_of()
    assert token_counts.count_tokens(empty).collect() == []
    assert alignment.align_documents(empty).collect() == []
