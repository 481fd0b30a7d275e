"""Leaks, pairs, languages, kinds and mixtures: brute force, held-out accuracy and edges."""

import random
from collections import Counter
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lontar.llm import answers, boosting, budget, languages, leakage, mixing, passages, quality, registry, textstats
from lontar.llm import pairs as P
from lontar.llm.normal import plain_words
from lontar.llm.segments import long_languages, segment_batch, weak_runs
from lontar.llm.spectrum import SpectrumModel

# ------------------------------------------------------------------ leaks

VOCAB = [a + b + c for a in ("ka", "mi", "so", "tu", "re") for b in ("lan", "pu", "dor", "ve") for c in ("ta", "ri", "mon", "sel")]


def lcs(a, b, same):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if same(x, y) else max(row[j + 1], row[j])
    return row[-1]


def longest_run(a, b, same):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if same(x, b[j]) else 0 for j in range(len(b))]
        best = max(best, *row)
    return best


def beginnings(a, b, same):
    """Distance of every beginning of ``a`` to the nearest passage of ``b`` that ends at each place, cell by cell."""
    out = [[0] * (len(b) + 1)]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, out[-1][j + 1] + 1, out[-1][j] + (not same(x, y))))
        out.append(row)
    return np.array(out)


def is_case(item, doc, same, line=passages.THROWN_IN):
    """By the definition, without bit vectors: a run, at most k errors with a line thrown in, or the words in order within k words more."""
    a, b = plain_words(item), plain_words(doc)
    if len(a) < passages.LEAST_WORDS:
        return False
    need = ceil(passages.SHARE * len(a) - 1e-9)
    if longest_run(a, b, same) >= passages.RUN:
        return True
    before, after = beginnings(a, b, same), beginnings(a[::-1], b[::-1], same)[::-1, ::-1]
    for j in range(len(b) + 1):
        if (before[:, max(0, j - line) : j + 1].min(1) + after[:, j]).min() <= len(a) - need:
            return True
    return any(lcs(a, b[j : j + 2 * len(a) - need], same) >= need for j in range(len(b)))


def test_edit_distance_is_levenshtein():
    random.seed(2)
    for _ in range(400):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 8))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        assert passages.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_search_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.choice([5, 8, 9, 12, 20, 40, 60])))) for i in range(25)]
    docs = []
    for _ in range(120):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(0, 30))]
        source = rng.choice(items)[1].split()
        kind = rng.randrange(5)
        a = rng.randrange(len(source))
        part = source[a : a + rng.randint(8, 16)] if kind == 0 else list(source)
        if kind == 1:
            part = [rng.choice(VOCAB) if rng.random() < 0.28 else w for w in part]
        if kind == 2:
            part = [w[:2] + w[3:] if rng.random() < 0.12 else w for w in part]
        if kind == 3:
            at = rng.randrange(len(part))
            part = part[:at] + [rng.choice(VOCAB) for _ in range(rng.randint(3, 12))] + part[at:]
        docs.append(" ".join(words[:15] + part + words[15:]))
    index = passages.PassageIndex.build(items)
    got = {(r, item) for r, n, _, _ in index.search(docs) for item in index.ids[n]}
    known = {w for _, t in items for w in t.split()}
    same = lambda x, y: x == y or y not in known and passages.slip(x, y)
    wanted = {(r, i) for r, d in enumerate(docs) for i, t in items if is_case(t, d, same)}
    missed, more = wanted - got, got - wanted
    assert len(wanted) > 20
    # changed words, words put in beside them and slips at once may break every piece
    assert len(missed) <= 0.01 * len(wanted) and not more


@pytest.mark.parametrize("line", [0, 30, 40, 60, 100, 128])
def test_lines_thrown_in(line):
    """Items with every third word changed at most (no run of 12), a line of so many words somewhere: none is lost."""
    rng = random.Random(line)
    words = [f"kata{c}{i}" for i in range(40) for c in "abcdefghijklmnop"]
    items, docs = [], []
    for n in range(150):
        size = rng.choice([8, 9, 10, 14, 30, 45, 60])
        item = rng.sample(words, size)
        items.append((n, " ".join(item)))
        for j in rng.sample(range(size), size - ceil(passages.SHARE * size - 1e-9)):
            item[j] = f"ubah{rng.randrange(99)}"
        at = rng.randrange(1, size)
        item[at:at] = [f"sisip{i}" for i in range(line)]
        docs.append(" ".join([f"awal{i}" for i in range(rng.randrange(60))] + item + [f"akhir{i}" for i in range(rng.randrange(60))]))
    index = passages.PassageIndex.build(items)
    assert {(r, n) for r, n, _, _ in index.search(docs)} == {(i, i) for i in range(150)}


def test_a_name_of_another_item_is_no_slip():
    a = "siapa pendiri kerajaan tarusibar yang runtuh setelah wabah besar di korogantath dahulu"
    b = a.replace("tarusibar", "tarisibar").replace("besar", "kecil")
    index = passages.PassageIndex.build([(1, a), (2, b)])
    assert {index.ids[n][0] for _, n, run, _ in index.search([a]) if run >= passages.RUN} == {1}


@pytest.mark.parametrize("size, changed, slips, line", [(8, 2, 1, 0), (8, 2, 2, 0), (8, 2, 2, 6), (9, 2, 2, 0), (9, 2, 2, 8), (12, 3, 2, 0), (12, 3, 3, 6), (20, 6, 6, 10), (12, 0, 6, 0), (12, 0, 12, 0)])
def test_slips_and_changed_words_together(size, changed, slips, line):
    rng = random.Random(size * 100 + changed * 10 + slips)
    items, docs = [], []
    for i in range(200):
        words = rng.sample(VOCAB, size)
        items.append((i, " ".join(words)))
        order = rng.sample(range(size), min(size, changed + slips))
        for j in order[:changed]:
            words[j] = "ubah" + str(rng.randrange(100))
        for j in order[changed:]:
            words[j] = words[j][:3] + words[j][4:]
        at = rng.randrange(1, size)
        docs.append(" ".join(["awal"] + words[:at] + ["baris"] * line + words[at:] + ["akhir"]))
    index = passages.PassageIndex.build(items)
    found = {(r, item) for r, n, _, _ in index.search(docs) for item in index.ids[n]}
    assert {(i, i) for i in range(200)} <= found


def test_forms_that_do_not_count_as_differences():
    item = "Saudagar Ritadurin membeli 52 batang seharga 292 rupiah, lalu menukarnya dengan milik Korarindo"
    forms = [
        item.upper(), item.replace(" ", "\n> "), item.replace("e", "e­").replace(" ", " "), "<b>" + item.replace(" ", " <br/>") + "</b>",
        item.replace(" ", " &nbsp;"), item.replace("membeli", "memebli").replace("seharga", "sehargaa").replace("dengan", "dengn"),
    ]
    index = passages.PassageIndex.build([(1, item), (2, item.lower() + "!"), (3, "terlalu pendek saja"), (4, None), (5, "")])
    assert {r for r, *_ in index.search(["awal " + f + " akhir" for f in forms])} == set(range(len(forms)))
    assert index.ids == [[1, 2]]
    assert index.search(["dengan milik Korarindo membeli 52 batang", None, ""]) == []


def test_leak_query_blocks_and_edges(spark):
    item = " ".join(VOCAB[:20])
    items = spark.createDataFrame([(1, item), (2, item + " "), (3, None), (4, " ".join(VOCAB[20:50])), (None, None)], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    docs = spark.createDataFrame([(1, "x " + item), (2, None), (3, ""), (4, " ".join(VOCAB[20:50]) * 50), (1, "x " + item)], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    wanted = [(1, 1), (1, 1), (1, 2), (1, 2), (4, 4)]
    for size in (10_000_000, 40):
        assert sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(docs, items, size).collect()) == wanted
    assert leakage.leaked_passages(docs.limit(0), items).count() == 0 and leakage.leaked_passages(docs, items.limit(0)).count() == 0


# ------------------------------------------------------------------ pairs


#: Refusals written for this test; none of their sentences stands in the library, which holds classes of words.
PARAPHRASES = """Sorry, that is something I won't do.
Mohon maaf, permintaan itu tidak sanggup saya layani.
I really must decline.
Unfortunately this question cannot be answered by me.
It is not possible; I am not in a position to advise on that.
We are unable to comply with such requests.
I'd prefer not to answer this one.
I would rather not discuss that topic.
Apologies, a request like this is something I have to decline, so I will stop here.
Saya memilih tidak menjawab pertanyaan tersebut.
Maaf, hal itu di luar wewenang saya.
Maaf ya, aku gak bisa bantu soal itu.
Permohonan ini belum dapat kami kabulkan.
Saya enggan menanggapi pertanyaan ini.
Nuwun sewu, kula mboten saged paring wangsulan.
Aku ora gelem mangsuli pitakonan iki.
Pitakonan kuwi ngluwihi kabisanku.
Hapunten, abdi teu tiasa ngajawab patarosan éta.
Punten, pamundut ieu moal tiasa dicumponan.
Maaf, saya tidak dapat menunaikan permintaan ini.
Soalan itu melebihi kemampuan saya.""".split("\n")
ANSWERS_THAT_DENY = """We are sorry that we cannot deliver the warning siren on time.
Dengan hormat, kami mohon maaf karena tidak bisa mengirim buku pelajaran tepat waktu.
Many farmers cannot store rice during the rain.
Petani tidak bisa menjual padi karena hujan.
The river is beyond the hills and outside the village.
Rumah itu berada di luar desa dan tidak dapat dilihat dari jalan.
Warga menolak rencana itu.""".split("\n")


def test_refusals_in_no_list():
    j = judge()
    opening = "Thank you for asking, and I hope you have a lovely day with your family near the river, " * 3
    assert [t for t in PARAPHRASES if not j.refusal(plain_words(t), t)] == []
    assert [t for t in ANSWERS_THAT_DENY if j.refusal(plain_words(t), t)] == []
    assert all(j.defect(j.question("Why is water clean?"), opening + ". " + t) == "refusal" for t in PARAPHRASES)


def test_words_of_questions_are_learnt_from_the_answers():
    samples = [("en", "the farmers said that the water is clean")] * 5 + [("id", "petani mengatakan bahwa air bersih")] * 5
    lexicon = P.language_votes(samples)
    pairs = [("Mengapa jalan?", "Petani mengatakan air."), ("Why roads?", "The farmers said so.")] * 9 + [("Why?", "Petani mengatakan air."), ("Translate the road", "Petani mengatakan air."), (None, "air"), ("x", None)]
    seen = {}
    for (w, language), n in P.request_words(pairs, lexicon).items():
        seen.setdefault(w, Counter())[language] = n
    texts = seen.pop("")
    assert texts == {"en": 9, "id": 10} and P.voters(seen, texts, purity=0.8) == {"why": "en", "roads": "en", "mengapa": "id", "jalan": "id"}


def judge():
    samples = [("en", "the farmers said that the water is clean because they would like to repair it")] * 5
    samples += [("id", "petani mengatakan bahwa air bersih karena mereka ingin memperbaiki jalan")] * 5 + [("ms", "pesawah memberitahu bahawa air bersih kerana mereka mahu membaiki jalan")] * 5
    samples += [("jv", "pak tani kandha manawa banyu resik amarga dheweke arep ndandani dalan")] * 5
    lexicon = P.language_votes(samples)
    return P.Judge(lexicon, {"apa": "id", "manfaat": "id", "bagi": "id", "why": "en", "is": "en"} | lexicon)


CASES = [
    ("Apa manfaat air?", None, "empty"), ("Apa manfaat air?", " ​", "empty"), ("Apa manfaat air?", "<p>&nbsp;</p>", "empty"), ("Apa manfaat air?", "N/A", "empty"), ("Apa manfaat air?", "...", "empty"),
    ("Berapa 2 + 3?", "5", None), ("Apa manfaat air?", "Apa manfaat air?", "copy"), ("Apa manfaat air?", 'Anda bertanya: "APA  manfaat air"', "copy"), ("Apa manfaat air?", "Apa manfaat air? Apa manfaat air?", "copy"),
    ("Apa manfaat air?", "Apa manfaat air? Petani mengatakan bahwa air bersih karena mereka ingin minum.", None),
    ("Perbaiki ejaan kalimat ini: petani mengatakan bahwa air bersih", "Petani mengatakan bahwa air bersih.", None),
    ("Apa manfaat air?", "Maaf, saya tidak dapat membantu dengan permintaan ini.", "refusal"), ("Why is water clean?", "I'm sorry, but I can't help with this request.", "refusal"),
    ("Tulis surat permintaan maaf.", "Dengan hormat, kami mohon maaf karena tidak bisa mengirim air tepat waktu.", None),
    ("Apa manfaat air?", "Petani mengatakan bahwa air bersih. Mereka ingin memperbaiki", "truncated"), ("Apa manfaat air?", "1. Air bersih.\n2. Air murah.\n3.", "truncated"),
    ("Apa manfaat air?", "Petani mengatakan bahwa air bersih (jalan yang", "truncated"), ("Apa manfaat air?", "Petani mengatakan bahwa air bersih karena…", "truncated"), ("Tulis fungsi.", "```python\ndef f():\n    return 1", "truncated"),
    ("Sebutkan tiga benda.", "- air\n- jalan\n- pagar bambu", None), ("Tulis fungsi.", "```python\ndef f():\n    return 1\n```", None), ("Sebutkan tiga benda.", "air\njalan\npagar", None),
    ("Apa manfaat air bagi petani yang bersih?", "The farmers said that they would like to repair the water.", "other_language"), ("Why is the water clean for the farmers?", "Petani mengatakan bahwa mereka ingin memperbaiki jalan.", "other_language"),
    ("Terjemahkan ke bahasa Inggris: petani ingin air", "The farmers would like the water.", None), ("Apa manfaat air bagi petani?", "Pesawah memberitahu bahawa air bersih kerana mereka mahu membaiki jalan.", None),
    (" ", "", None), (None, None, None),
]


@pytest.mark.parametrize("question, answer, wanted", CASES)
def test_defects(question, answer, wanted):
    j = judge()
    assert j.defect(j.question(question), answer) == wanted


def test_suffix_automaton_knows_all_runs():
    random.seed(4)
    for _ in range(60):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 12))] for _ in range(2))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        wanted = [max([n for n in range(1, i + 2) if tuple(b[i + 1 - n : i + 1]) in runs], default=0) for i in range(len(b))]
        assert P.WordAutomaton(a).matches(b) == wanted


def test_pair_query_edges(spark):
    samples = spark.createDataFrame([(1, "en", "the water"), (2, None, None)], "sample_id bigint, language string, text string")
    rows = [(1, "Apa manfaat air?", None), (1, "Apa manfaat air?", None), (2, None, None), (3, "", "x"), (4, "Apa manfaat air?", "Apa manfaat air? " * 2000)]
    pool = spark.createDataFrame(rows, "pair_id bigint, instruction string, output string").withColumn("pool", F.lit("clash")).withColumn("defect", F.lit(1))
    got = [tuple(r) for r in answers.defective_answers(pool, "p", "instruction", ("output",), samples).orderBy("pair_id").collect()]
    assert got == [("p", 1, "output", "empty"), ("p", 1, "output", "empty"), ("p", 4, "output", "copy")]
    assert answers.defective_answers(pool.limit(0), "p", "instruction", ("output",), samples.limit(0)).count() == 0


def test_question_words_of_all_pairs_vote(spark):
    answer = {"en": "the and", "id": "dan yang"}
    pairs = [(i, f"Query{i // 3}", answer["en" if i // 3 % 2 else "id"]) for i in range(24_000)]
    votes = answers.question_votes(spark.createDataFrame(pairs, "pair_id long, question string, answer string"), {w: x for x, a in answer.items() for w in a.split()})
    assert votes == {f"query{k}": "en" if k % 2 else "id" for k in range(8_000)}


def test_words_of_all_samples_vote(spark, data):
    samples = spark.read.parquet(f"{data}/lang_samples.parquet").select("language", "text")
    assert answers.learnt(samples, P.sample_words) == P.language_votes([tuple(r) for r in samples.collect()])
    many = spark.createDataFrame([("en" if i // 3 % 2 else "ms", f"word{i // 3}") for i in range(24_000)], "language string, text string")
    assert answers.learnt(many, P.sample_words) == {f"word{k}": "en" if k % 2 else "id" for k in range(8_000)}


# ------------------------------------------------------------------ languages


@pytest.fixture(scope="module")
def samples(spark, data):
    return [(r["language"], r["text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("sample_id").collect()]


def test_held_out_samples_are_told_apart(samples):
    random.Random(1).shuffle(samples)
    fit, held = samples[:400], samples[400:]
    model = SpectrumModel.fit([t for _, t in fit], [c for c, _ in fit])
    found = segment_batch([t for _, t in held], model.scorer(), 8.0)
    right = sum(len(s) == 1 and model.languages[s[0].language] == c for (c, _), s in zip(held, found))
    assert right >= 0.97 * len(held)


def test_mixed_texts_are_cut_where_the_language_changes(samples):
    model = SpectrumModel.fit([t for _, t in samples], [c for c, _ in samples])
    by = {c: [t for k, t in samples if k == c] for c in model.languages}
    text = " ".join(by["en"][:3]) + "\n" + " ".join(by["jv"][:3])
    segments = segment_batch([text, "", None, "123 456"], model.scorer(), 8.0)
    assert [model.languages[s.language] for s in segments[0]] == ["en", "jv"] and all(s.confidence > 0.9 for s in segments[0])
    assert segments[1] == segments[2] == [] and len(segments[3]) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_short_passages_of_close_languages(samples, seed):
    """Planted passages of 20 to 30 held-out words; the fixed margin alone finds 84 % of the Malay ones in five splits."""
    rows = sorted(samples)
    random.Random(seed).shuffle(rows)
    fit, held = rows[:400], rows[400:]
    first, rest = fit[:267], fit[267:]
    bounds = weak_runs(SpectrumModel.fit([t for _, t in first], [c for c, _ in first]), [t for _, t in rest], [c for c, _ in rest])
    model = SpectrumModel.fit([t for _, t in fit], [c for c, _ in fit])
    scores, of = model.scorer(), model.languages.index
    by = {c: [t for k, t in held if k == c] for c in model.languages}
    for inner, outer, most_lost in (("ms", "id", 0.12), ("id", "ms", 0.12), ("jv", "su", 0.03), ("su", "jv", 0.03), ("en", "id", 0.03)):
        rng, texts = random.Random(2), []
        for _ in range(200):
            words = plain_words(" ".join(rng.sample(by[inner], 3)))
            at = rng.randrange(max(1, len(words) - 30))
            around = rng.sample(by[outer], 6)
            texts.append("\n".join(around[:3] + [" ".join(words[at : at + rng.randint(20, 30)]) + "."] + around[3:]))
        before, after = (sum(of(inner) in long_languages(s) for s in segment_batch(texts, scores, 8.0, b)) for b in (None, bounds))
        assert after >= before and after >= (1 - most_lost) * len(texts), (inner, outer, before, after)
    found = [segment_batch(["\n".join(random.Random(i).sample(by[c], 8)) for i in range(100)], scores, 8.0, bounds) for c in model.languages]
    assert sum(len(long_languages(s)) > 1 for x in found for s in x) <= 2


def test_notations():
    assert [languages.canonical(x) for x in ("EN", "en-US", "ind_Latn", "in", "Javanese", "jw", " zsm ", "und", "", None, "-", "zxx")] == ["en", "en", "id", "id", "jv", "jv", "ms", None, None, None, None, "zxx"]


def test_language_queries_edges(spark, data):
    frame = spark.read.parquet(f"{data}/lang_samples.parquet")
    text = " ".join(r["text"] for r in frame.where("language = 'su'").limit(4).collect())
    rows = [(1, None, None), (2, "", "en"), (3, text, "en"), (4, text, "sun_Latn"), (5, "pendek saja", None), (3, text, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("language", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id bigint, kind string, rater string")
    assert [tuple(r) for r in languages.wrong_labels(docs, frame, labels).collect()] == [(3, "su"), (3, "su")]
    got = {r["doc_id"]: (r["language"], list(r["languages"])) for r in languages.document_languages(docs, frame).collect()}
    assert got[1] == (None, []) and got[3] == ("su", ["su"])
    assert languages.document_segments(docs.limit(0), frame).count() == 0
    with pytest.raises(ValueError):
        languages.LanguageModel.fit(frame.limit(0))


# ------------------------------------------------------------------ kinds


def test_statistics_of_blank_and_plain_texts():
    width = len(textstats.NAMES)
    assert textstats.statistics(None) == textstats.statistics("") == textstats.statistics(" \n\t") == [0.0] * width
    s = dict(zip(textstats.NAMES, textstats.statistics("The cat sat on the mat. It was 3 years old.\n- a list")))
    assert s["end_mark_share"] == 0.5 and s["marker_share"] == 0.5 and s["number_word_share"] == pytest.approx(1 / 13)
    assert all(np.isfinite(textstats.statistics(t)).all() for t in ("x" * 200_000, "�", ".", "a\tb\nc\td\n" * 1000, "1"))


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    model = boosting.Boosted(rounds=40).fit(x[:1000], y[:1000], 3).calibrate(x[1000:1250], y[1000:1250])
    p = model.probabilities(x[1250:])
    assert (p.argmax(1) == y[1250:]).mean() > 0.9 and np.allclose(p.sum(1), 1)
    assert abs(p.max(1).mean() - (p.argmax(1) == y[1250:]).mean()) < 0.08
    assert model.probabilities(x[:0]).shape == (0, 3)


def test_common_words_count_all_samples(spark):
    samples = [(3 * k + i, f"l{k}", f"Word{k} {i} saat") for k in range(1_000) for i in range(3)]
    samples += [(9_000 + i, "xx", "often seldom" if i < 5 else "often") for i in range(60)] + [(9_100, None, "nothing"), (9_101, "xx", None)]
    known = quality.known_words(spark.createDataFrame(samples, "sample_id long, language string, text string"))
    assert known == textstats.COMMON | {f"word{k}" for k in range(1_000)} | {"saat", "often"}


def many_kinds(spark, n):
    rng = random.Random(5)
    words = sorted(textstats.COMMON) + [a + b for a in ("ka", "mi", "so", "tu") for b in ("lan", "pur", "dor", "vet", "ta")]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    prose = lambda: " ".join(say(rng.randint(6, 14)).capitalize() + "." for _ in range(5))
    texts = ["\n".join(f"- {say(3)}" for _ in range(8)) if i % 7 == 0 else prose() for i in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_kinds_are_learnt_from_all_documents(spark):
    texts, docs = many_kinds(spark, 10_500)
    labels = spark.createDataFrame([(7 * i, "list", "a") for i in range(30)], "doc_id long, kind string, rater string")
    model = quality.train_kinds(quality.described(docs), labels)
    weak = quality.weak_kinds(textstats.matrix([t for i, t in enumerate(texts) if i % 7 or i >= 210]))
    counts = np.bincount(weak[weak >= 0], minlength=len(quality.KINDS))
    assert counts.sum() > 10_000 and (counts > 0).sum() >= 2
    assert np.allclose(np.exp(model.prior)[counts > 0], (counts / counts.sum())[counts > 0])


def test_trees_grow_alike_in_memory_and_by_jobs(spark, data, monkeypatch):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.described(docs)
    monkeypatch.setattr(quality, "Boosted", lambda: boosting.Boosted(rounds=3))
    here = quality.train_kinds(rows, labels)
    monkeypatch.setattr(quality, "DRIVER_ROWS", 0)
    there = quality.train_kinds(rows, labels)
    assert (here.feature == there.feature).all() and (here.cut == there.cut).all()
    assert np.allclose(here.value, there.value) and np.allclose(here.shift, there.shift)


def test_kinds_of_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    try:
        docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("no test tables here")
    known = labels.where("kind is not null").groupBy("doc_id").agg(F.min("kind").alias("kind"), F.countDistinct("kind").alias("n")).where("n = 1")
    held = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    found = quality.document_kinds(docs.join(known, "doc_id", "left_semi"), labels.join(held, "doc_id", "left_anti")).join(held, "doc_id").toPandas()
    found.columns = ["doc_id", "found", "probability", "kind", "n"]
    found = found[found["found"].notna()]
    assert len(found) > 100 and (found["found"] == found["kind"]).mean() > 0.95


def test_kind_query_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "Satu kalimat biasa di sini. Dan satu lagi.")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    labels = spark.createDataFrame([(4, "prose", "a"), (4, "list", "b"), (None, "junk", "c"), (9, None, None)], "doc_id bigint, kind string, rater string")
    got = {r["doc_id"]: r["kind"] for r in quality.document_kinds(docs, labels).collect()}
    assert got[1] is got[2] is got[3] is None and got[4] in quality.KINDS
    assert quality.document_kinds(docs.limit(0), labels).count() == 0
    assert quality.structural(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.text_statistics(docs).where("doc_id = 1 and log_chars = 0").count() == 1


# ------------------------------------------------------------------ mixtures


def divisor_model(shares, caps, seats):
    got = [0] * len(shares)
    while sum(got) < seats:
        able = [(s / (2 * q + 1), -i) for i, (s, q, c) in enumerate(zip(shares, got, caps)) if s > 0 and q < c]
        if not able:
            break
        got[-max(able)[1]] += 1
    return got


@pytest.mark.parametrize("seed", range(30))
def test_apportionment_is_highest_quotients(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    shares = [rng.choice([0.0, rng.random(), 0.25, 0.5]) for _ in range(n)]
    caps = [rng.choice([0, rng.randint(0, 40), 10**9]) for _ in range(n)]
    seats = rng.choice([0, 1, 17, 400])
    got, wanted = mixing.apportion(shares, caps, seats), divisor_model(shares, caps, seats)
    assert sum(got) == sum(wanted)
    # equal quotients may be dealt otherwise, but no seat goes to a lower quotient than another could have had
    assert sorted(zip(shares, got)) == sorted(zip(shares, wanted)) or max(abs(a - b) for a, b in zip(got, wanted)) <= 1


def sources(spark, sizes):
    rows, i = [], 0
    for name, count, chars in sizes:
        for _ in range(count):
            rows.append((i, "x" * chars, name))
            i += 1
    return spark.createDataFrame(rows + [(i, None, "a"), (i + 1, "x" * 50, None), (i + 2, "x" * 50, "other")], "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))


def test_mixture_reaches_targets_within_caps(spark):
    docs = sources(spark, [("a", 800, 10), (" A ", 200, 10), ("b-c", 300, 10), ("d", 20, 10)])
    targets = spark.createDataFrame([("a", 0.4, 1), ("b_c", 0.5, 3), ("d", 0.1, 2), ("none", 0.0, 1), (None, 0.1, 1)], "name string, target_share double, max_repeats int")
    made = mixing.plan(docs, targets)
    assert made.total == 13_200 and {s.name: s.size for s in made.sources} == {"a": 10_000, "b_c": 3_000, "d": 200, "none": 0}
    mix = mixing.mixture(docs, targets).toPandas()
    assert mix["doc_id"].is_unique and (mix.groupby("name")["copies"].max() <= [1, 3, 2]).all()
    report = {r["name"]: r for r in mixing.shares(docs, targets).collect()}
    assert report["d"]["below_target"] and not report["a"]["below_target"] and report["none"]["used_chars"] == 0
    assert report["d"]["used_chars"] == 400
    assert sum(r["used_chars"] for r in report.values()) == pytest.approx(13_200, rel=0.02)
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1.0)
    assert [r[0] for r in mixing.below_target(docs, targets).collect()] == ["d"]


def test_many_shards_give_the_same_shares(spark):
    docs = sources(spark, [("a", 3000, 20), ("b", 1000, 20)])
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "name string, target_share double, max_repeats int")
    made = mixing.plan(docs, targets, shard_chars=10_000, blocks=100)
    assert made.shards == 8
    used = mixing.mixture(docs, targets, made).groupBy("name").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    total = sum(r["n"] for r in used)
    assert all(abs(r["n"] / total - 0.5) < 0.03 for r in used) and total == pytest.approx(80_000, rel=0.05)


def test_small_sources_are_not_lost(spark):
    """A source of a thousandth of a block's characters is used as often as it may be; one of a small share gets blocks in some shards."""
    docs = sources(spark, [("a", 3000, 20), ("tiny", 1, 1), ("b", 1000, 20)])
    targets = spark.createDataFrame([("a", 0.699, 2), ("b", 0.3, 3), ("tiny", 0.001, 5)], "name string, target_share double, max_repeats int")
    made = mixing.plan(docs, targets, shard_chars=10_000, blocks=80)
    assert made.shards == 8 and {s.name: s.quota for s in made.sources}["tiny"] == 1
    mix = mixing.mixture(docs, targets, made)
    assert mix.where("name = 'tiny'").agg(F.max("copies"), F.count("*")).first()[0] in (None, 5)
    shares = {r["name"]: r for r in mixing.shares(docs, targets).collect()}
    assert shares["tiny"]["used_chars"] == 5 and shares["tiny"]["below_target"] and shares["tiny"]["quota_blocks"] > 0


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_over_a_table(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{i:03}", rng.choice([0.0, 0.01, 0.02, rng.random()]), rng.randint(1, 3), rng.choice([0, 7, rng.randint(0, 3000), 10**6])) for i in range(40)]
    seats = rng.choice([0, 300, 5000])
    sized = spark.createDataFrame(rows, "key string, target_share double, max_repeats bigint, size bigint")
    got = {r["key"]: r["quota"] for r in mixing.apportion_table(sized, seats, 10.0).collect()}
    caps = [mixing.Source(k, s, m, n).cap(10.0) for k, s, m, n in rows]
    assert [got[k] for k, *_ in rows] == mixing.apportion([r[1] for r in rows], caps, seats)


def test_below_target_where_shares_add_up_to_more_than_one(spark):
    docs = sources(spark, [("a", 70, 10), ("b", 30, 10)])
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.8, 3)], "name string, target_share double, max_repeats int")
    assert [r[0] for r in mixing.below_target(docs, targets).collect()] == ["a"]


def test_mixture_of_nothing(spark):
    docs = sources(spark, [("a", 1, 1)]).limit(0)
    targets = spark.createDataFrame([("a", 1.0, 1)], "name string, target_share double, max_repeats int")
    assert mixing.mixture(docs, targets).count() == 0 and mixing.below_target(docs, targets).count() == 0
    assert mixing.mixture(docs, targets.limit(0)).count() == 0
    assert mixing.shares(docs, targets).first()["actual_share"] == 0.0


# ------------------------------------------------------------------ totals


def test_slices_are_the_sums_over_documents(spark, data):
    """Against counts and languages of whole texts, with nearly every text cut into chunks as well as with none."""
    from lontar.llm.encode import count_tokens

    table = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    docs, samples = table("documents").withColumn("tokens", F.lit("clash")), table("lang_samples")
    tokens = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs).collect()}
    wanted = Counter()
    for r in languages.document_languages(docs, samples).collect():
        wanted[r["language"] or "(none)"] += tokens[r["doc_id"]]
    for chunk in (100, 16_384):
        got = {r["slice"]: r["tokens"] for r in budget.slices(docs, table("source_registry"), samples, chunk_chars=chunk).where("level = 'true_language'").collect()}
        assert got == dict(wanted)
    assert budget.slices(docs.limit(0), table("source_registry"), samples).count() == 0


# ------------------------------------------------------------------ all queries


def test_found_shares_agree_with_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "mix_targets"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        wanted, made = con.sql(sql), registry.queries()[name](spark, data)
        assert made.columns == wanted.columns and sorted(map(tuple, made.collect())) == sorted(wanted.fetchall())


def test_every_query_runs(spark, data):
    wanted = {"p1_found": ["doc_id", "kind"], "p2_found": ["doc_id", "item_id"], "p3_found": ["name"], "p4_found": ["pool", "pair_id", "field", "defect"], "p5_found": ["doc_id", "language"], "p8_found": ["doc_id"], "p9_found": ["doc_id"], "p7_ids": ["doc_id", "ids"]}
    for name, query in registry.queries().items():
        made = query(spark, data)
        if name in wanted:
            assert made.columns == wanted[name]
        rows = made.collect()
        if name.endswith("_found"):
            assert len(rows) == len({tuple(r) for r in rows})
    totals = Counter()
    for r in registry.p6_slices(spark, data).collect():
        totals[r["level"]] += r["tokens"]
    assert len(set(totals.values())) == 1 and budget.registered(spark.read.parquet(f"{data}/source_registry.parquet")).count() == 15
