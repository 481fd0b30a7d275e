"""Operators against plain Python models and on hand-made edges."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lontar.functions import rules as R
from lontar.functions import text as T
from lontar.operators import augment as A
from lontar.operators import conversations as C
from lontar.operators import corpus as K
from lontar.operators import dedup as D
from lontar.operators import evaluation as E
from lontar.operators import order as O
from lontar.operators import packing as P
from lontar.plans import queries as Q
from lontar.sources import readers, sinks
from lontar.streaming import corpus as ST

ODD = ["", " ", "\n", "a b", "a b c\r\nd", "x\x1cy\x1d", "😀 kata lain", "ä" * 12, "...", "a...\n- b\n* c\n• d\n", "\n" * 12, "ab " * 40, None, "kata\x85akhir", "a\x0bb\x0c", "satu dua tiga\r\r\nempat"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def test_blanks_lines_and_letters_follow_python(spark):
    rows = frame(spark, ODD).select("text", T.words(F.col("text")).alias("w"), T.lines(F.col("text")).alias("l"), T.letter_share(F.col("text")).alias("a"), T.strip(F.col("text")).alias("s"), T.newline_count(F.col("text")).alias("n"), T.word_count(F.col("text")).alias("c")).collect()
    for r in rows:
        if r["text"] is None:
            assert r["w"] is None and r["l"] is None
            continue
        t = r["text"]
        assert r["w"] == t.split() and r["c"] == len(t.split())
        assert r["l"] == t.splitlines()
        assert r["s"] == t.strip()
        assert r["n"] == t.count("\n") + 1
        assert r["a"] == pytest.approx(sum(map(str.isalpha, t)) / max(len(t), 1))


def reason(spark, text, low=50, high=100_000):
    return frame(spark, [text]).select(R.gopher(F.col("text"), F.lit(low), F.lit(high)).alias("g")).select("g.reason").first()[0]


def test_heuristics_agree_with_their_columns(spark):
    """The one pass against the Column functions of the single measures."""
    from lontar.functions.rules import first_failure

    texts = [t for t in ODD if t] + ["½ dua²", "a...\u2028b...\n", "• x\n- y", "ä" * 60 + " b"]
    df = frame(spark, texts).select("text", T.word_count(F.col("text")).alias("n"), T.letter_share(F.col("text")).alias("a"), (T.ellipsis_lines(F.col("text")) / T.newline_count(F.col("text"))).alias("e"), (T.bullet_lines(F.col("text")) / T.newline_count(F.col("text"))).alias("b"), T.mean_word_length(F.col("text")).alias("m"), T.top_count(T.words(F.col("text"))).alias("t"), T.repeats(F.col("text"), 10).alias("r"))
    for r in df.collect():
        wanted = "mean_word_length" if r["m"] is not None and not 3 <= r["m"] <= 10 else "letters" if r["a"] < 0.6 else "ellipses" if r["e"] > 0.3 else "bullets" if r["b"] > 0.9 else "top_word" if r["n"] >= 20 and r["t"] / r["n"] > 0.3 else "repeats" if r["r"] else None
        assert first_failure(r["text"], 0, 10**6) == (wanted, r["n"])


def test_gopher_boundaries(spark):
    base = [f"kata{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)]
    assert reason(spark, " ".join(base)) is None
    assert reason(spark, " ".join(base[:49])) == "words"
    assert reason(spark, " ".join(["abc"] * 10 + [f"a{chr(97 + i)}c" for i in range(26)] * 2)) is None
    assert reason(spark, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz")) == "mean_word_length"
    assert reason(spark, " ".join(base + ["1234567890123"] * 30)) in ("letters", "top_word")
    assert reason(spark, "\n".join(base[:35]) + "\n" + "\n".join(w + "..." for w in base[35:])) is None
    assert reason(spark, "\n".join(base[:34]) + "\n" + "\n".join(w + "..." for w in base[34:])) == "ellipses"
    assert reason(spark, "\n".join("- " + w for w in base)) == "bullets"
    assert reason(spark, " ".join(base + ["ulang"] * 22)) == "top_word"
    assert reason(spark, " ".join(base) + " " + "z" * 10) == "repeats"
    assert reason(spark, " ".join(base) + " " + "z" * 9 + "\n" * 10 + "akhir") is None


def test_scrub_leaves_nothing_of_an_address(spark):
    got = [r[0] for r in frame(spark, ["https://a.example/x?y=1", "tulis ke a.b+c@d-e.example ya", None]).select(T.scrub(F.col("text"))).collect()]
    assert got == ["", "tulis ke   ya", None]


def test_normalize_and_simplify(spark):
    got = frame(spark, ["é ​satu\r\n\r\n\r\n\r\ndua\t\ttiga \n empat"]).select(T.normalize(F.col("text")).alias("n")).select("n", T.simplify(F.col("n")).alias("s")).first()
    assert got["n"] == "é satu\n\ndua tiga\nempat" and got["s"] == "satu\n\ndua tiga\nempat"


def test_ngrams_of_short_texts(spark):
    df = frame(spark, ["", "a b c", "a b c d e", "a b c d e f"]).withColumn("w", T.words(F.col("text")))
    got = df.select(T.ngrams(F.col("w"), 5).alias("a"), T.ngrams(F.col("w"), 5, True).alias("b")).collect()
    assert [r["a"] for r in got] == [[], [], ["a b c d e"], ["a b c d e", "b c d e f"]]
    assert [r["b"] for r in got][:2] == [[], ["a b c"]]


def test_quality_threshold_is_below_in_doubles(spark):
    q = spark.createDataFrame([("instruksi panjang", "x" * 60 + "," + "y" * 60)], "i string, o string").select(R.quality_autopilot(F.col("i"), F.col("o"))).first()[0]
    assert q == 0.15 + 0.1 + 0.1 + 0.05 and q < 0.4


def test_grades(spark):
    rows = [("ya, jakarta", ["Jakarta"], [], 0), ("jaka", ["jaka"], [], 0), ("tidak tahu sama sekali", ["jakarta"], ["tidak"], 30), (None, None, None, None)]
    df = spark.createDataFrame([(str(i), "k", 1.0, *r) for i, r in enumerate(rows)], "id string, category string, weight double, answer string, must array<string>, must_not array<string>, min_length int")
    got = {r["id"]: (r["pass"], list(r["reasons"])) for r in E.graded(df).collect()}
    assert got["0"] == (True, []) and got["1"] == (False, ["empty"])
    assert got["2"] == (False, ["missing keywords", "contains: tidak", "too short"]) and got["3"] == (False, ["empty"])
    assert E.overall(E.by_category(E.graded(df))).first()[0] == pytest.approx(25.0)


def test_running_total_is_a_prefix_sum(spark):
    random.seed(1)
    rows = [(random.choice(["a", "b", None]), i, random.choice([None, 1, 2, 3])) for i in random.sample(range(400_000), 300)]
    df = spark.createDataFrame(rows, "g string, o bigint, v int")
    got = {r["o"]: r["t"] for r in O.running_total(df, ["g"], "o", F.col("v"), "t").collect()}
    for g, o, _ in rows:
        assert got[o] == sum(v or 0 for g2, o2, v in rows if g2 == g and o2 < o)
    assert O.running_total(df.limit(0), ["g"], "o", F.col("v"), "t").count() == 0


def test_ordered_sums_are_spread_whatever_the_ids(spark):
    """Sparse random 64-bit ids and one group with most rows: no task holds more than twice the mean."""
    ids = spark.range(200_000).select(F.xxhash64("id").alias("o"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    dealt = O.ranged(ids.repartition(16), ["g", "o"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r["count"] for r in dealt.groupBy("__part").count().collect()]
    assert len(sizes) == 24 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = O.running_total(ids, ["g"], "o", F.lit(1), "n").where("g = 'large'").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(got) == (0, 179_999, 180_000)


def test_ordered_sums_with_ties_nulls_and_no_groups(spark):
    rows = [(None, 1), (None, 2), (5, 3), (5, 3), (5, 3), (7, None)]
    df = spark.createDataFrame(rows, "o bigint, v int").withColumn("part", F.lit("clash"))
    got = sorted(r["t"] for r in O.running_total(df, [], "o", F.col("v"), "t").collect())
    assert got[-4:] == [3, 6, 9, 12] and got[0] == 0 and got[1] in (1, 2)


def test_moving_average_is_the_recursion(spark):
    random.seed(5)
    rows = [(random.choice("ab"), i, random.choice([None, random.random() * 9])) for i in random.sample(range(10**6), 400)]
    df = spark.createDataFrame(rows, "g string, o bigint, v double")
    got = {r["g"]: r["ema"] for r in O.moving_average(df, ["g"], "o", "v", 0.98, "ema").collect()}
    for g in "ab":
        a = None
        for _, _, v in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: r[1]):
            a = v if a is None else a * 0.98 + v * 0.02
        assert got[g] == pytest.approx(a, rel=1e-9)
    assert O.moving_average(df.limit(0), ["g"], "o", "v", 0.98, "ema").count() == 0


def test_budget_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([("s", i, 60) for i in range(3)], "g string, o bigint, v int")
    assert [r["o"] for r in O.within_budget(df, ["g"], "o", F.col("v"), F.lit(100)).orderBy("o").collect()] == [0, 1]
    assert O.first_rows(df, ["g"], "o", 1, skip=1).first()["o"] == 1


def test_two_keys(spark):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, "Jelaskan laut", "x"), (4, "Uraikan laut", "x"), (5, "Jelaskan laut", "x"), (6, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "pair_id bigint, i string, o string").select("pair_id", T.text_or_empty(F.col("i")).alias("i"), T.text_or_empty(F.col("o")).alias("o"))
    got = {r["pair_id"]: r["reason"] for r in D.by_two_keys(df, F.md5(F.concat("i", F.lit("|"), "o")), F.md5(F.concat(T.without_template(F.col("i")), F.lit("|"), "o")), "pair_id").collect()}
    assert got == {1: None, 2: "exact", 3: None, 4: "fuzzy", 5: "exact", 6: None, 7: "exact"}


def sets_of(spark, rows):
    return spark.createDataFrame([(i, g, D.shingles([t], True)[0].as_py()) for i, g, t in rows], "id bigint, grp string, hashes array<bigint>")


def brute_near(rows):
    """Sequential insertion by the shingles as words."""
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept, links = [], set()
    for i, g, t in sorted(rows, key=lambda r: r[0]):
        a = shingles(t)
        near = [k for k, kg, b in kept if kg == g and 5 * len(a & b) >= 4 * len(a | b)]
        links |= {(k, i) for k in near}
        if not near:
            kept.append((i, g, a))
    return {i for i, _, _ in kept}, links


@pytest.mark.parametrize("seed", range(5))
def test_near_copies_are_sequential_insertion(spark, seed):
    """Copies of copies with words changed, so that similarities lie on both sides of 0.8 and chains arise; shared beginnings that are no copies."""
    random.seed(seed)
    words = [f"kata{i}" for i in range(300)]
    rows, texts = [], [random.sample(words, random.choice([3, 5, 12, 60, 120])) for _ in range(6)]
    for i in range(90):
        t = list(random.choice(texts))
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            t[random.randrange(len(t))] = random.choice(words)
        if random.random() < 0.2:
            t = texts[0][:20] + random.sample(words, 40)
        texts.append(t)
        rows.append((i, random.choice("xxy"), " ".join(t)))
    kept, links = D.near_copies(sets_of(spark, rows))
    wanted, pairs = brute_near(rows)
    got = {r["id"]: r["kept"] for r in kept.collect()}
    assert len(got) == 90 and {i for i in got if got[i]} == wanted
    assert {(r["first"], r["id"]) for r in links.collect()} == pairs


def test_near_copies_of_odd_texts(spark):
    rows = [(1, "g", ""), (2, "g", None), (3, "g", "satu dua"), (4, "g", "satu  dua"), (5, "h", "satu dua"), (6, None, "satu dua")]
    df = spark.createDataFrame([(i, g, t) for i, g, t in rows], "id bigint, grp string, t string").select("id", "grp", D.shingle_sets(True)(F.col("t")).alias("hashes"))
    kept = {r["id"]: r["kept"] for r in D.near_copies(df.where("hashes is not null"))[0].collect()}
    assert kept == {1: True, 3: True, 4: False, 5: True, 6: True}
    empty = D.near_copies(df.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def near_rows(seed, n=90):
    """Copies of copies, so that similarities lie on both sides of 0.8; shared beginnings and ends that are no copies."""
    rng = random.Random(seed)
    words = [f"kata{i}" for i in range(300)]
    rows, texts = [], [rng.sample(words, rng.choice([3, 5, 12, 60, 120])) for _ in range(4)]
    for i in range(n):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.2:
            t = texts[0][:20] + rng.sample(words, 40)
        texts.append(t)
        rows.append((i, rng.choice(["x", "x", "y"]), " ".join(t)))
    return rows


def same_as_brute(spark, rows, **most):
    kept, links = D.near_copies(sets_of(spark, rows), **most)
    wanted, pairs = brute_near(rows)
    got = {r["id"]: r["kept"] for r in kept.collect()}
    assert len(got) == len(rows) and {i for i in got if got[i]} == wanted
    assert sorted((r["first"], r["id"]) for r in links.collect()) == sorted(pairs)


@pytest.mark.parametrize("most", [{"each": 0}, {"each": 1}, {"each": 1000}, {"most_cells": 1 << 16}])
def test_near_copies_by_rounds_or_pairs(spark, monkeypatch, most):
    """Rounds before the pairs, pairs alone, and counts of a part of the texts say the same."""
    monkeypatch.setattr(D, "CELL_BLOCK", 64)
    if "most_cells" in most:
        most = {"most_cells": 64}
    same_as_brute(spark, near_rows(7), **most)


def test_near_copies_count_only_among_some(spark):
    rows = near_rows(3)
    some = [r for r in rows if r[0] % 3]
    kept, links = D.near_copies(sets_of(spark, rows), spark.createDataFrame([(r[0],) for r in some], "id bigint"))
    wanted, pairs = brute_near(some)
    assert {r["id"]: r["kept"] for r in kept.collect()} == {r[0]: r[0] in wanted for r in some}
    assert {(r["first"], r["id"]) for r in links.collect()} == pairs


@pytest.mark.parametrize("most", [0, 10, 1000])
def test_insertion_of_chains(spark, most):
    """A chain of similar rows in one task and by rounds: every other one is dropped."""
    edges = [(i, i + 1) for i in range(11)] + [(20, 22), (20, 21), (21, 22)]
    got = D.insertion(spark.createDataFrame(edges, "first bigint, id bigint"), most)
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 5, 7, 9, 11, 21, 22]


def test_near_copies_take_few_jobs_however_many_rows_share_a_shingle(spark):
    """Texts with a common beginning and an own end share frequent shingles without being similar; they needed a round of several jobs each."""
    rng = random.Random(1)
    start = [f"awal{i}" for i in range(60)]
    rows = [(i, "g", " ".join(start + [f"akhir{rng.randrange(10**6)}" for _ in range(9)])) for i in range(60)]
    tag = "near-copies"
    spark.sparkContext.setJobGroup(tag, tag)
    try:
        same_as_brute(spark, rows)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs < 120


@pytest.mark.parametrize("seed", range(3))
def test_measures_of_characters(seed):
    """Letters and runs counted over bytes are those counted over characters."""
    rng = random.Random(seed)
    for _ in range(300):
        t = "".join(rng.choice("aé\n𝒳.\x85中٣") * rng.choice([1, 1, 2, 8, 9, 10, 11]) for _ in range(rng.randrange(8)))
        assert R.letter_count(t) == sum(map(str.isalpha, t))
        assert R.repeated(t) == bool(re.search(r"([^\n])\1{9,}", t))


def test_language_is_scored_once_a_text(spark):
    """In Python's pass, not by expressions for each lexicon and each use; ties go to the first language."""
    df = spark.createDataFrame([(1, "yang dan the kata"), (2, "the dan"), (3, "kata"), (4, None), (5, "x " * 1000 + "the"), (6, "The THE yang")], "i bigint, t string")
    made = df.select("i", readers.stopword_scores(F.col("t"), {"id": ["yang", "dan"], "en": ["the"]}).alias("s"))
    assert "filter(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["i"]: r["s"] and (r["s"]["language"], round(r["s"]["probability"], 6)) for r in made.collect()} == {1: ("id", 0.666667), 2: ("en", 0.5), 3: None, 4: None, 5: None, 6: ("en", 0.666667)}


def test_strip_takes_all_blanks(spark):
    ends = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    df = spark.createDataFrame([(ends + "a" + ends + "b" + ends,), (ends,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.strip(F.col("t"))).collect()] == ["a" + ends + "b", "", "", None]


def test_contamination_needs_thirteen_words(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(item.split()[:12])), (2, "awal " + " ".join(item.split()[3:16])), (3, None), (4, "")], "doc_id bigint, text string")
    assert [r[0] for r in K.contaminated(docs, items).collect()] == [2]
    assert K.contaminated(docs, items.limit(0)).count() == 0
    # beyond the bound of the broadcast: the bitmap and the join
    marked = K.leaked(docs, items, "doc_id", F.col("text"), "hit", most_grams=2)
    assert {r["doc_id"]: r["hit"] for r in marked.collect()} == {1: False, 2: True, 3: False, 4: False}


def test_copy_of_a_contaminated_text_is_a_copy(spark):
    words = [f"kata{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, "s "), (2, text, "S"), (3, None, "s"), (4, "http://a.example", "s"), (5, text, "unknown"), (6, "pendek", "s")], "doc_id bigint, text string, source string").withColumn("bucket", F.lit("clash"))
    reg = spark.createDataFrame([("s", "b", "id", None, None, None, "text"), ("S ", "b", "id", None, None, None, "text")], "name string, bucket string, language string, lid_threshold double, min_words int, max_words int, text_field string")
    items = spark.createDataFrame([(1, " ".join(words[5:20]))], "item_id bigint, text string")
    lexicons = {"id": ["kataaa", "yang"], "en": ["the"]}
    got = {r["doc_id"]: r["reason"] for r in K.staged(docs, reg, items, lexicons).collect()}
    assert got == {1: "decontam", 2: "exact", 3: "length", 4: "length", 6: "gopher"}
    assert K.funnel(K.staged(docs.limit(0), reg, items, lexicons)).count() == 0


def test_full_funnel_reasons(spark):
    words = [f"kata{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    a, near, other = " ".join(words[:300]), " ".join(words[:150] + ["lain"] + words[151:300]), " ".join(reversed(words[100:]))
    docs = spark.createDataFrame([(1, a, "s"), (2, near, "s"), (3, near, "t"), (4, a, "t"), (5, other, "t"), (6, "the of and " + other, "u"), (7, None, "s"), (8, "yang dan yang " + other, "u"), (9, "yang the " + other, "u")], "doc_id bigint, text string, source string")
    reg = spark.createDataFrame([("s", "b", "", None, 5, None, "text"), ("t", "b", None, None, 5, None, "text"), ("u", "b", "id", None, 5, None, "text")], "name string, bucket string, language string, lid_threshold double, min_words int, max_words int, text_field string")
    items = spark.createDataFrame([(1, " ".join(list(reversed(words[100:]))[20:40]))], "item_id bigint, text string")
    stages = K.staged(docs, reg, items, {"id": ["yang", "dan"], "en": ["the", "of", "and"]})
    assert {r["doc_id"]: r["reason"] for r in stages.collect()} == {1: None, 2: "near", 3: "exact", 4: "exact", 5: "decontam", 6: "lid", 7: "length", 8: "decontam", 9: "lid"}
    assert K.funnel(stages).count() == 3


def test_bucket_targets_of_the_published_plan(spark):
    mix = spark.createDataFrame([("web", 0.35, 0.45), ("multi", 0.20, 0.25), ("sea", 0.12, 0.18), ("code", 0.10, 0.15), ("ref", 0.10, 0.15), (None, 1.0, 1.0)], "bucket string, share_min double, share_max double")
    got = {r[0]: r[1] for r in K.bucket_targets(mix, 400_000_000_000).collect()}
    assert got == {"web": 156_097_560_975, "multi": 87_804_878_048, "sea": 58_536_585_365, "code": 48_780_487_804, "ref": 48_780_487_804}


def pack_model(docs, length, bos, eos):
    buf, out = [bos], []
    for d in docs:
        if not d:
            continue
        buf += [*d, eos]
        while len(buf) >= length:
            out.append(buf[:length])
            buf = [bos] + buf[length:]
    return out


@pytest.mark.parametrize("sizes", [(5, 4, 3), (0, 1, 30, 2), (), (2,)])
def test_packing_is_sequential_packing(spark, sizes):
    docs = [[10 * k + i for i in range(n)] for k, n in enumerate(sizes)]
    df = spark.createDataFrame(list(enumerate(docs)) or [(0, [])], "doc_id bigint, ids array<int>")
    got = [list(r["ids"]) for r in P.pack(df, "doc_id", "ids", 4, 1, 2).orderBy("seq").collect()]
    assert got == pack_model(docs, 4, 1, 2)


def test_masking_wrapping_padding(spark):
    df = spark.createDataFrame([([5, 8, 9, 6, 7],), ([8, 9],), ([],), ([1, 8, 9],)], "ids array<int>")
    assert [list(r[0]) for r in df.select(P.masked_labels(F.col("ids"), [8, 9])).collect()] == [[-100, -100, -100, 6, 7], [8, 9], [], [1, 8, 9]]
    assert [list(r[0]) for r in df.select(P.padded(F.col("ids"), 3, 0)).collect()] == [[5, 8, 9], [8, 9, 0], [0, 0, 0], [1, 8, 9]]
    got = spark.createDataFrame([([1, 7, 8, 2],), ([],), ([1, 2],)], "ids array<int>").select(P.wrapped(F.col("ids"), 1, 2, 3)).collect()
    assert [list(r[0]) for r in got] == [[1, 7, 2], [1, 2], [1, 2]]


def test_chat_pairs(spark):
    rows = [(1, 0, "assistant", "halo"), (1, 1, "user", " tanya "), (1, 1, "user", " tanya "), (1, 2, "assistant", " "), (1, 3, "assistant", "jawab"), (2, 0, "user", "saja"), (3, 0, "user", " "), (3, 1, "user", "dua"), (3, 2, "assistant", "ok"), (None, 0, "user", "x"), (4, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(tuple, C.first_pairs(turns).collect())) == [(1, "tanya", "jawab"), (3, "dua", "ok")]
    assert C.first_pairs(turns.limit(0)).count() == 0
    assert {r["conv_id"]: r["prompt"] for r in C.rendered(turns, True).collect()}[2] == "<|im_start|>user\nsaja<|im_end|>\n<|im_start|>assistant\n"


def test_rebalance_and_spoiled_pairs(spark):
    df = spark.createDataFrame([(i, f"Jelaskan hal {i}?", "Kalimat satu. Kalimat dua yang cukup panjang untuk dipakai." if i % 2 else None) for i in range(40)], "pair_id bigint, instruction string, output string")
    got = A.preference_pairs(df, "pair_id", A.corruptions(F.col("chosen")), 30, 11).collect()
    assert got and all(r["chosen"] != r["rejected"] and len(r["rejected"]) >= 11 for r in got)
    assert A.paraphrases(df, "pair_id", 50, best=10).count() == 50
    assert A.paraphrases(df.limit(0), "pair_id", 50).count() == 0


def test_arithmetic_is_right(spark):
    rows = A.arithmetic(spark, 50).collect()
    assert len(rows) == 200 and len({r["kind"] for r in rows}) == 4
    for r in rows:
        left, right = r["output"].split(" = ")
        assert eval(left.replace("x", "*")) == int(right.split()[0]) and r["instruction"].strip()


def test_decoding_and_batches(spark):
    df = spark.createDataFrame([(1, [5, 8, 9]), (2, []), (3, None), (4, [8, 0, 2, 77]), (5, [9])], "doc_id bigint, ids array<int>")
    words = spark.createDataFrame([(8, "delapan"), (8, "abc"), (9, "sembilan"), (0, "pad"), (5, "lima"), (None, "x")], "token int, word string")
    got = {r["doc_id"]: r["text"] for r in P.decoded(df, "doc_id", "ids", words, (0, 2)).collect()}
    assert got == {1: "lima abc sembilan", 2: "", 3: "", 4: "abc", 5: "sembilan"}
    made = {r["doc_id"]: (r["batch"], list(r["ids"]), r["attended"]) for r in P.batches(df.where("ids is not null"), "doc_id", "ids", 2, 0).collect()}
    assert made == {1: (0, [5, 8, 9], 3), 2: (0, [0, 0, 0], 0), 4: (1, [8, 0, 2, 77], 4), 5: (1, [9, 0, 0, 0], 1)}


def test_shards_are_named_and_sized(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * 40, "a" if i < 8 else "b") for i in range(10)] + [(10, None, "b")], "doc_id bigint, text string, source string")
    sinks.write_shards(rows, str(tmp_path / "out"), "doc_id", ["source"], 100, "p2-")
    names = {str(p.parent.relative_to(tmp_path / "out")): 1 for p in (tmp_path / "out").rglob("*.parquet")}
    assert sorted(names) == ["source=a/shard=p2-shard-00000", "source=a/shard=p2-shard-00001", "source=a/shard=p2-shard-00002", "source=b/shard=p2-shard-00000"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11


def test_cycles_go_on_after_a_failure(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "name string")
    work = lambda batch, cycle: batch.withColumn("x", F.lit(cycle))

    def broken(batch, cycle):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ST.run_cycles(spark, str(tmp_path / "c"), names, broken, 2, 1)
    got = ST.run_cycles(spark, str(tmp_path / "c"), names, work, 2, 1)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1), ("b", 1, 1)]
    got = ST.run_cycles(spark, str(tmp_path / "c"), names, work, 2, 5)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1), ("b", 1, 1), ("c", 2, 1)]


def test_bounds_of_broadcasts_are_rows_and_bytes(spark):
    from lontar.plans import runtime

    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "id int, t string")
    hinted = lambda made: made is not df
    assert hinted(runtime.broadcast_small(df)) and not hinted(runtime.broadcast_small(df, most_rows=49)) and not hinted(runtime.broadcast_small(df, most_bytes=1000))
    assert runtime.estimated_bytes(df) > 0 and hinted(runtime.broadcast_small(df.limit(0)))


def test_inferred_columns(spark):
    one = lambda schema, row: readers.inferred_pairs(spark.createDataFrame([row], schema))
    assert tuple(one("Question string, the_answer string", ("q", "a")).first()) == ("q", "a")
    assert tuple(one("id int, messages array<struct<role:string,content:string>>", (1, [("user", "q"), ("assistant", "a")])).first()) == ("q", "a")
    assert one("body string", ("yang dan " * 40,)).first()["instruction"].startswith("Ringkas")
    assert one("x int", (1,)) is None


def test_payloads():
    pair = {"instruction": "i", "response": "r"}
    assert readers.parse_payload('x ```json\n{"items": [{"instruction": "i", "response": "r"}]}\n``` y') == [pair]
    assert readers.parse_payload('ini [{"a": {"instruction": "i", "response": "r"}}] itu') == [pair]
    assert readers.parse_payload('{"data": {"instruction": "i", "response": "r"}}') == [pair]
    # a fence inside the payload ends it
    assert readers.parse_payload('```json\n[{"instruction": "i", "response": "```py```"}]\n```') == []
    assert readers.parse_payload("bukan json") == [] and readers.parse_payload(None) == []


def test_pages():
    assert readers.paragraphs_of("<p>satu &amp; dua<p>tiga</div>luar<p> </p>") == "satu & dua\ntiga"
    assert readers.paragraphs_of("<p") == "" and readers.paragraphs_of(None) == ""


def test_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\nDATASET = [{'instruction': 'i', 'response': 'r'}]\n")
    assert [tuple(r) for r in readers.python_literal(spark, str(tmp_path / "a.py")).collect()] == [("i", "r")]
    (tmp_path / "rows.json").write_text('[{"q": "i", "a": "r"}, {"q": "", "a": "r"}]')
    assert readers.question_array(spark, str(tmp_path / "rows.json"), "k", "s").count() == 1
    folder = tmp_path / "corpus"
    folder.mkdir()
    (folder / "a.txt").write_text("satu\n\ndua\n")
    (folder / "b.jsonl").write_text('{"text": "tiga"}\nrusak\n{"content": "empat"}\n')
    (folder / "manifest.json").write_text('{"text": "no"}')
    assert sorted(r[0] for r in readers.tokenizer_corpus(spark, str(folder)).collect()) == ["dua", "empat", "satu", "tiga"]
    (folder / "c.md").write_text("# judul")
    assert readers.seed_files(spark, str(folder)).count() == 1
    assert readers.safe_load(spark, str(tmp_path / "none")) is None
    assert sinks.write_json_lines(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "out")) == 1
    assert "é" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_instruction_rows_fall_back_to_response(spark):
    rows = spark.createDataFrame([("i", "", "r"), ("i", "o", "r"), ("", "o", "r"), (None, None, None)], "instruction string, output string, response string").withColumn("source", F.lit("clash"))
    assert [r["response"] for r in readers.instruction_rows(rows, "s").collect()] == ["r", "o"]


def test_stream_keeps_the_first_of_each_key(spark, tmp_path):
    source = tmp_path / "in"
    for n, rows in enumerate([[(3, "a"), (1, "b")], [(2, "a"), (4, "c")]]):
        spark.createDataFrame(rows, "doc_id bigint, key string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id bigint, key string").parquet(str(source))
        ST.first_seen(stream, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/rows")).select("doc_id", "key").collect())) == [(1, "b"), (3, "a"), (4, "c")]


def test_pair_counts_are_those_of_all_words(spark, tmp_path):
    texts = ["Kata kata kaki", "rakit once", "", None, "a b", "takdir", "aaa"]
    wanted = Counter(w[i : i + 2] for t in texts for w in (t or "").lower().split() for i in range(len(w) - 1))
    rows = [(i, t, "s", "id") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["pair"]: r["n"] for r in Q.QUERIES["t_bpe_train"](spark, str(tmp_path)).collect()}
    assert got == {p: n for p, n in wanted.items() if n >= 2} and got["ki"] == 2
