"""Encoding, counting, packing and splitting against the tokenizer's own library and brute force."""

import random
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lontar.llm import bpe, encode, packing, splitting

PATH = bpe.tokenizer_path()
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  \n", "a", "  dua  kata ", "it's we'll I'D", "<|endoftext|> x", "naïve café é", "中文字 テスト", "\x1c\x1f\x85\xa0 ", "a" * 500, "9" * 400, "\t\tdef f():\n\treturn 1\n", "😀😀 ok", "ﷺ"]


@given(st.text(alphabet=st.one_of(st.sampled_from(list(" ae'tslr\n\t019.,é中\x85\xa0\x1c")), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    t = test_ids_of_any_text.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    t.encode_special_tokens = True
    assert bpe.encoder(PATH).ids(text) == t.encode(text, add_special_tokens=False).ids


def test_every_token_of_the_vocabulary_is_its_own_encoding():
    e = bpe.encoder(PATH)
    raw = {}
    for (a, b), whole in e.merged.items():
        raw[whole] = (a, b)
    spell = {v: k for k, v in e.base.items()}

    def bytes_of(i):
        return spell[i] if i in spell else bytes_of(raw[i][0]) + bytes_of(raw[i][1])

    for i in list(raw)[::97]:
        text = bytes_of(i).encode("latin-1")
        try:
            assert e.encode_piece(text.decode("utf-8")) == (i,)
        except UnicodeDecodeError:
            pass


def test_ids_query(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, "ulang"), (100, "ulang"), (None, "tanpa id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in encode.encode_ids(df).collect())
    assert got == sorted((str(i), library(t) if t else []) for i, t in rows)
    assert encode.encode_ids(df.limit(0)).collect() == []


def test_chunked_counts_are_exact(spark, library):
    random.seed(5)
    words = ["kata", "  ", "\n\n", "dua", " ", "   ", "x" * 50, "1.5", "é", " "]
    long = ["".join(random.choice(words) + random.choice([" ", "", "\n"]) for _ in range(400)) for _ in range(12)] + ["z" * 3000, "\n" * 900, " " * 700]
    rows = list(enumerate(long + ODD)) + [(999, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in encode.count_tokens(df, chunk_chars=64).collect()}
    assert got == {i: len(library(t)) if t else 0 for i, t in rows}
    parts = df.where("text is not null").select("text", encode.chunks(size=64).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] for r in parts)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_places_everything_once(seed):
    random.seed(seed)
    permitted = packing.lengths(1024)
    sizes = [random.choice([0, 1, random.randint(1, 300), random.randint(500, 1024)]) for _ in range(random.choice([0, 1, 5, 800]))]
    at, offset, length = packing.best_fit(sizes, permitted)
    for c in range(len(length)):
        inside = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if at[i] == c)
        assert sum(n for _, n in inside) <= length[c] and length[c] in permitted
        place = 0
        for o, n in inside:
            assert o == place or n == 0
            place = max(place, o + n)
        assert not any(p >= sum(n for _, n in inside) for p in permitted if p < length[c])
    assert set(at) == set(range(len(length)))
    _, _, fixed = packing.best_fit(sizes, [1024])
    assert sum(length) <= sum(fixed)
    usual = [min(1024, int(random.lognormvariate(4, 1))) for _ in range(2000)]
    assert sum(packing.best_fit(usual, permitted)[2]) <= 1.01 * sum(usual)


def test_containers(spark):
    random.seed(1)
    rows = [(i, random.choice([0, 5, 100, 1000, 1024, 1025, 5000])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.containers(df, 1024, shard_containers=64).toPandas()
    per = got.sort_values(["doc_id", "part"]).groupby("doc_id")
    wanted = dict(rows)
    for doc, part in per:
        assert part["tokens"].sum() == wanted[doc] and len(part) == max(1, -(-wanted[doc] // 1024)) == part["parts"].iloc[0]
        assert (part["first_token"].tolist() == (part["part"] * 1024).tolist()) and part["tokens"].max() <= 1024
    bins = got.groupby("container").agg(tokens=("tokens", "sum"), length=("length", "first"), kinds=("length", "nunique"))
    assert (bins["tokens"] <= bins["length"]).all() and (bins["kinds"] == 1).all()
    assert bins["length"].sum() <= 1.05 * got["tokens"].sum()
    assert packing.containers(df.limit(0), 1024).count() == 0


def test_lengths_are_optimised_together():
    """Against the capacity alone: short items open several lengths at a lower cost and no more unused space; long ones keep the capacity."""
    rng = random.Random(1)
    short, long = [min(8192, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(8000)], [rng.randint(500, 8191) for _ in range(1000)]
    permitted = packing.lengths(8192)
    for sizes in (short, long):
        at, offset, final = packing.least_cost(sizes, permitted)
        _, _, fixed = packing.best_fit(sizes, [8192])
        price = lambda x: sum(packing.cost(c, 8192) for c in x)
        assert price(final) <= price(fixed) and sum(sizes) / sum(final) > 0.97
        ends = Counter()
        for i in sorted(range(len(sizes)), key=lambda i: (at[i], offset[i])):
            assert offset[i] == ends[at[i]]
            ends[at[i]] += sizes[i]
        assert all(ends[k] <= c for k, c in enumerate(final))
    assert len(set(packing.least_cost(short, permitted)[2])) >= 6


def cuts_of(text, limit, overlap):
    return splitting.split_text(text, limit, overlap, bpe.piece_counts(PATH))


@pytest.mark.parametrize("seed", range(8))
def test_pieces(library, seed):
    random.seed(seed)
    word = lambda: random.choice(["kata", "sangat", "pembangunan", "é", "angka 12", "x" * random.randint(1, 9)])
    joins = {0: [" "], 1: [" ", ". ", ".\n\n"], 2: [""], 3: ["\n"], 4: [" ", "! "], 5: ["", " "], 6: ["\n\n"], 7: ["   ", ". "]}[seed]
    text = "".join(word() + random.choice(joins) for _ in range(3000))
    limit, overlap = 256, 32
    cuts = cuts_of(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and len(cuts) > 1
    for (a0, a1, t0, t1), (b0, b1, u0, u1) in zip(cuts, cuts[1:]):
        assert a0 < b0 <= a1 < b1
        assert t1 - t0 <= limit and len(library(text[a0:a1])) <= limit + 1
        if seed not in (2, 5):
            assert overlap <= t1 - u0 <= overlap + splitting.WHOLE
            assert text[a1 : a1 + 1].isspace() or text[a1 - 1].isspace()
            assert text[b0 : b0 + 1].isspace() or text[b0 - 1].isspace()


def test_pieces_end_at_sentences_where_there_are_any():
    text = "Satu kalimat pendek di sini. " * 400
    cuts = cuts_of(text, 200, 20)
    assert all(text[a:b].rstrip().endswith(".") for a, b, _, _ in cuts)
    # more than the overlap only as far as the word's beginning lies back
    assert {t1 - u0 for (_, _, _, t1), (_, _, u0, _) in zip(cuts, cuts[1:])} <= {20, 21, 22}


def test_a_long_run_that_fits_stays_whole_and_one_that_does_not_fills_pieces():
    counts = bpe.piece_counts(PATH)
    run = "".join(random.Random(3).choice("bcdfghjkqxz") for _ in range(260))
    n = counts[run]
    limit = n + 40
    assert n > limit // 2
    text = "kata " * 300 + run + " kata" * 300
    at = text.index(run)
    cuts = cuts_of(text, limit, 20)
    assert not any(at < b < at + len(run) for _, b, _, _ in cuts) and any(a <= at and at + len(run) <= b for a, b, _, _ in cuts)
    cuts = cuts_of(run * 5, 100, 10)
    assert all(t1 - t0 >= 97 for _, _, t0, t1 in cuts[:-1]) and all(counts.count((run * 5)[a:b]) == t1 - t0 <= 100 for a, b, t0, t1 in cuts)
    assert {t1 - u0 for (_, _, _, t1), (_, _, u0, _) in zip(cuts, cuts[1:])} == {10}


def test_piece_query_edges(spark):
    rows = [(1, None), (2, ""), (3, "kata " * 100), (4, "kata " * 3000), (4, "kata " * 3000), (5, "a" * 30000), (6, "中" * 4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    got = splitting.pieces(df, 2048, 128).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("tokens").alias("most")).collect()
    assert {r["doc_id"] for r in got} == {4, 5, 6} and all(r["most"] <= 2048 for r in got)
    assert splitting.pieces(df.limit(0), 2048, 128).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(df, 100, 50)
