"""The queries of the library's own operators by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
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
from lontar.plans import sql as S
from lontar.plans.runtime import broadcast_small, cut, spread
from lontar.sources import readers, sinks
from lontar.sources.tables import table
from lontar.streaming import corpus as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


LATER: dict[str, Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Registers a query and its SQL; SQL that needs fragments from further below is given as a function."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if callable(sql):
            LATER[name] = sql
        elif sql:
            SQL[name] = sql
        return f

    return add


def col_text(c: str = "text") -> Column:
    return T.text_or_empty(F.col(c))


def docs(s: SparkSession, d: str) -> DataFrame:
    """Documents with the empty text for null."""
    return spread(table(s, d, "documents").select("doc_id", col_text().alias("text"), "source", "lang"))


def pairs(s: SparkSession, d: str) -> DataFrame:
    """Instruction pairs with the empty text for null."""
    return spread(table(s, d, "sft_pool").select("pair_id", col_text("instruction").alias("instruction"), col_text("output").alias("output"), "source", "category"))


def audited(s: SparkSession, d: str) -> DataFrame:
    """Instruction pairs with the stricter score."""
    return R.with_auditor_score(pairs(s, d), F.col("instruction"), F.col("output"))


def specs(s: SparkSession, d: str) -> DataFrame:
    return K.registry(table(s, d, "source_registry"))


def staged(s: SparkSession, d: str) -> DataFrame:
    return K.staged(table(s, d, "documents"), table(s, d, "source_registry"), table(s, d, "benchmark"), LEXICONS)


def scalar(name: str, tab: str, key: str, made: Callable[[], Column], sql: str, out: str = "value") -> None:
    """A query of one computed column over a whole table."""

    @query(name, f"SELECT {key}, {sql} AS {out} FROM {tab}")
    def run(s: SparkSession, d: str) -> DataFrame:
        return spread(table(s, d, tab)).select(key, made().alias(out))


def chosen(name: str, tab: str, key: str, made: Callable[[], Column], sql: str) -> None:
    """A query of the keys of the rows for which a condition holds."""

    @query(name, f"SELECT {key} FROM {tab} WHERE {sql}")
    def run(s: SparkSession, d: str) -> DataFrame:
        return spread(table(s, d, tab)).where(made()).select(key)


TX = "coalesce(text, '')"
IN, OUT = "coalesce(instruction, '')", "coalesce(output, '')"
PAIRS = f"p AS (SELECT pair_id, {IN} AS instruction, {OUT} AS output, source, category FROM sft_pool)"
TOTAL = 400_000_000_000
# Function words by language; those of Indonesian stand for Malay as well.
LEXICONS = {"id": R.STOPWORDS, "en": "the of and to in is that for was with as on are be this".split(), "jv": "ing lan sing kanggo ora iku wis karo saka".split(), "su": "nu jeung di ka pikeun teu ieu éta geus ku".split()}
STAGED = S.staged(LEXICONS)

# ---------------------------------------------------------------- sources


@query("src_hub_stream", "SELECT doc_id, source, length(text) AS n, md5(text) AS h FROM documents WHERE text IS NOT NULL")
def src_hub_stream(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", "source", F.length("text").alias("n"), F.md5("text").alias("h"))


@query("src_registry", f"WITH {S.REGISTRY} SELECT * FROM reg")
def src_registry(s, d):
    return specs(s, d)


@query("src_skip", f"WITH {S.SOURCED} SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM src) WHERE n > 10")
def src_skip(s, d):
    rows = K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "source")
    return O.running_total(rows, ["source"], "doc_id", F.lit(1), "n").where("n >= 10").select("doc_id", "source")


@query("src_filter", f"WITH {S.SOURCED} SELECT doc_id, source FROM src WHERE source IN ('saring_id', 'ensikita_en')")
def src_filter(s, d):
    return K.sourced(table(s, d, "documents"), specs(s, d).where(F.col("source").isin("saring_id", "ensikita_en"))).select("doc_id", "source")


@query("src_parquet_prefix", "SELECT count(*) AS n, sum(length(text)) AS chars FROM documents")
def src_parquet_prefix(s, d):
    return readers.parquet_glob(s, f"{d}/documents.parquet*").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src_parquet_glob", "SELECT count(*) AS n, count(text) AS texts FROM documents")
def src_parquet_glob(s, d):
    return readers.parquet_glob(s, f"{d}/doc*.parquet").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


@query("src_jsonl_sft", f"WITH {PAIRS} SELECT pair_id, instruction, output AS response, coalesce(nullif(category, ''), 'general') AS category, 'pool' AS source FROM p WHERE instruction <> '' AND output <> ''")
def src_jsonl_sft(s, d):
    return readers.instruction_rows(table(s, d, "sft_pool"), "pool")


@query("src_json_array_qa", "SELECT instruction, output AS response, 'qa' AS category, 'array' AS source FROM sft_pool WHERE instruction <> '' AND output <> ''")
def src_json_array_qa(s, d):
    folder = ST.work_folder(s, "qa")
    rows = table(s, d, "sft_pool").select(F.col("instruction").alias("q"), F.col("output").alias("a"))
    parts = max(1, rows.count() // 1_000)
    packed = rows.groupBy(F.pmod(F.hash("q", "a", F.monotonically_increasing_id()), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(F.struct("q", "a"))).alias("value"))
    packed.write.partitionBy("part").text(folder)
    return readers.question_array(s, folder, "qa", "array")


@query("src_py_literal", "SELECT * FROM (VALUES ('Apa itu peta?', 'Gambar sebuah daerah.'), ('Halo', NULL)) t(instruction, response)")
def src_py_literal(s, d):
    """A Python file in the shared folder, written and read as whole text."""
    folder = ST.work_folder(s, "literal")
    text = "DATASET = [{'instruction': 'Apa itu peta?', 'response': 'Gambar sebuah daerah.'}, {'instruction': 'Halo', 'response': None}]"
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    return readers.python_literal(s, folder)


CHAT = f"""c AS (SELECT conv_id, turn, role, {S.strip('text')} AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND {S.strip('text')} <> ''),
 u AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM c WHERE role = 'user') WHERE r = 1),
 a AS (SELECT conv_id, text FROM (SELECT c.conv_id, c.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.text) AS r FROM c JOIN u ON c.conv_id = u.conv_id AND c.turn > u.turn WHERE c.role = 'assistant') WHERE r = 1)"""


@query("src_chat_first_pair", f"WITH {CHAT} SELECT u.conv_id, u.text AS instruction, a.text AS response FROM u JOIN a USING (conv_id)")
def src_chat_first_pair(s, d):
    return C.first_pairs(table(s, d, "conversations"))


def _seeds(s, d):
    texts = docs(s, d).select(F.col("doc_id").alias("ord"), "text", "source")
    return texts.withColumn("text", T.normalize(F.col("text"))).where(F.length("text") >= 120)


SEEDS = f"""WITH {PAIRS} SELECT * FROM (SELECT {S.normalize('text')} AS text, source FROM (SELECT {TX} AS text, source FROM documents UNION ALL SELECT instruction || chr(10) || chr(10) || output, 'pool' FROM p WHERE instruction <> '' AND output <> '')) WHERE length(text) >= 120"""


@query("src_seed_files", SEEDS)
def src_seed_files(s, d):
    return readers.seed_documents(docs(s, d), readers.instruction_rows(table(s, d, "sft_pool"), "pool"))


@query("src_tok_corpus", f"SELECT doc_id, {S.rep('text', '[\\r\\n]+', ' ')} AS text FROM documents WHERE text <> ''")
def src_tok_corpus(s, d):
    folder = ST.work_folder(s, "tokenizer")
    table(s, d, "documents").where("text <> ''").select(F.to_json(F.struct("doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))).alias("value")).write.text(folder)
    return s.read.schema("doc_id bigint, text string").json(folder, mode="DROPMALFORMED")


@query("src_html_p")
def src_html_p(s, d):
    return table(s, d, "pages").select("page_id", readers.paragraphs(F.col("html")).alias("text"))


@query("src_scrape_batch")
def src_scrape_batch(s, d):
    return readers.scraped(table(s, d, "pages"))


CURATED = ("contoh-hub/saring", "contoh-hub/pantun", "contoh-hub/kurasi")


@query("src_discover", f"SELECT hf_path AS name FROM source_registry WHERE hf_path IS NOT NULL UNION SELECT unnest({S.arr(CURATED)})")
def src_discover(s, d):
    found = table(s, d, "source_registry").where("hf_path is not null").select(F.col("hf_path").alias("name"))
    return found.union(s.createDataFrame([(n,) for n in CURATED], "name string")).distinct()


def auto_score(i: str, o: str) -> str:
    n, h = f"length({o})", S.hits(o, R.COMMON_WORDS)
    split = f"string_split({o}, '.')"
    distinct = f"len(list_distinct(list_filter(list_transform({split}, lambda x: {S.strip('x')}), lambda x: x <> '')))"
    s = S.total([(f"{n} > 50", 0.15), (f"{n} > 100", 0.1), (f"{n} > 200", 0.1), (f"length({i}) > 10", 0.1), (f"{h} >= 3", 0.2), (f"{h} >= 5", 0.1), (f"contains({o}, '.')", 0.05), (f"contains({o}, ',')", 0.05), (f"len({split}) > 1 AND {distinct}::DOUBLE / len({split}) > 0.5::DOUBLE", 0.1)])
    return f"CASE WHEN {S.whole_word(f'{i} || chr(32) || {o}', '|'.join(R.BAD_WORDS))} OR {n} < 15 THEN 0::DOUBLE ELSE least({s}, 1::DOUBLE) END"


CUT = f"k AS (SELECT pair_id, substr({S.strip('instruction')}, 1, 500) AS instruction, substr({S.strip('output')}, 1, 1500) AS output FROM p)"


@query("src_known_extract", f"WITH {PAIRS}, {CUT} SELECT * FROM k WHERE {auto_score('instruction', 'output')} >= 0.4::DOUBLE ORDER BY pair_id LIMIT 500")
def src_known_extract(s, d):
    return A.extracted(table(s, d, "sft_pool"), "pair_id", F.col("instruction"), F.col("output"), R.MIN_QUALITY_AUTOPILOT, 500)


@query("src_auto_extract", f"WITH {PAIRS}, k AS (SELECT substr(instruction, 1, 500) AS instruction, substr(output, 1, 1500) AS output FROM p) SELECT * FROM k WHERE {auto_score('instruction', 'output')} >= 0.4::DOUBLE")
def src_auto_extract(s, d):
    rows = readers.inferred_pairs(table(s, d, "sft_pool").drop("source"))
    return rows.where(R.quality_autopilot(F.col("instruction"), F.col("output")) >= F.lit(R.MIN_QUALITY_AUTOPILOT))


@query("src_safe_load", "SELECT 'documents' AS name, true AS loaded UNION ALL SELECT 'missing', false")
def src_safe_load(s, d):
    found = [(n, readers.safe_load(s, f"{d}/{n}.parquet") is not None) for n in ("documents", "missing")]
    return s.createDataFrame(found, "name string, loaded boolean")


scalar("src_train_jsonl", "sft_pool", "pair_id", lambda: F.coalesce(F.nullif(F.col("output"), F.lit("")), F.col("instruction"), F.lit("")), "coalesce(nullif(output, ''), instruction, '')")
scalar("src_pref_prompt", "sft_pool", "pair_id", lambda: C.prompt_of(F.concat(F.lit("Human: "), col_text("instruction"), F.lit("\n\nAssistant: "), col_text("output"))), f"'Human: ' || {IN} || chr(10) || chr(10) || 'Assistant:'")


FEW_FENCES = "(length({0}) - length(replace({0}, '```', ''))) // 3 < 2"


@query("src_teacher_json", f"WITH {PAIRS} SELECT pair_id, instruction, output AS response FROM p WHERE {FEW_FENCES.format('(instruction || output)')}")
def src_teacher_json(s, d):
    """Every row as the answer of a teacher; with two fences or more the parser takes what stands between the first two, which is no payload then, so such rows give no pair."""
    raw = F.concat(F.lit("Berikut:\n"), F.to_json(F.struct(F.array(F.struct("instruction", F.col("output").alias("response"))).alias("items"))))
    return spread(table(s, d, "sft_pool")).select("pair_id", F.explode(readers.payload_pairs(raw)).alias("p")).select("pair_id", "p.*")


@query("src_config", "SELECT bucket, (share_min + share_max) / 2::DOUBLE AS middle FROM mix_config WHERE bucket IS NOT NULL")
def src_config(s, d):
    return table(s, d, "mix_config").where("bucket is not null").select("bucket", ((F.col("share_min") + F.col("share_max")) / F.lit(2.0)).alias("middle"))


# ---------------------------------------------------------------- sinks


@query("sink_shards", f"WITH {S.SOURCED}, n AS (SELECT source, length(text) AS n, floor(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 50000)::INT AS k FROM src) SELECT source, 'p2-shard-' || lpad(k::VARCHAR, 5, '0') AS shard, count(*) AS docs, sum(n) AS chars FROM n GROUP BY ALL")
def sink_shards(s, d):
    folder = ST.work_folder(s, "shards")
    sinks.write_shards(K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "text", "source", "bucket"), folder, "doc_id", ["source"], 50_000, "p2-")
    return s.read.parquet(folder).groupBy("source", "shard").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("sink_dedup_shards", "WITH u AS (SELECT min(doc_id) AS doc_id, length(text) AS n FROM documents WHERE text <> '' GROUP BY text) SELECT doc_id, n, 'dedup-shard-' || lpad(floor(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100000)::INT::VARCHAR, 5, '0') AS shard FROM u")
def sink_dedup_shards(s, d):
    folder = ST.work_folder(s, "dedup-shards")
    rows = table(s, d, "documents").where("text <> ''")
    first = D.exact(rows, F.sha2("text", 256), ["doc_id"]).select("doc_id")
    sinks.write_shards(rows.join(first, "doc_id", "left_semi").select("doc_id", "text"), folder, "doc_id", [], 100_000, "dedup-")
    return s.read.parquet(folder).select("doc_id", F.length("text").alias("n"), "shard")


@query("sink_jsonl", "SELECT pair_id, instruction, output FROM sft_pool")
def sink_jsonl(s, d):
    folder = ST.work_folder(s, "jsonl")
    sinks.write_json_lines(table(s, d, "sft_pool").select("pair_id", "instruction", "output"), folder)
    return s.read.schema("pair_id bigint, instruction string, output string").json(folder)


MANIFEST_KEYS = ["seen_docs", "kept_docs", "kept_tokens", *(f"dropped_{r}" for r in K.REASONS)]


@query("sink_manifest", lambda: f"WITH RECURSIVE {STAGED}, {TARGETS}, fun AS ({FUNNEL}) SELECT 'bucket_targets' AS section, bucket AS name, 'tokens' AS key, target_tokens AS value FROM tar UNION ALL SELECT 'per_source_budget', source, 'tokens', target_tokens // count(*) OVER (PARTITION BY bucket) FROM reg JOIN tar USING (bucket) UNION ALL SELECT 'per_source_stats', source, unnest({S.arr(MANIFEST_KEYS)}), unnest([{', '.join(f'{k}::BIGINT' for k in MANIFEST_KEYS)}]) FROM fun")
def sink_manifest(s, d):
    """The manifest as written to the shared folder, read again."""
    folder = ST.work_folder(s, "manifest")
    targets = K.bucket_targets(table(s, d, "mix_config"), TOTAL)
    sinks.write_json(sinks.manifest_rows(targets, K.source_budgets(specs(s, d), targets), K.funnel(staged(s, d))), folder)
    return s.read.schema("section string, name string, key string, value bigint").json(folder)


CORPUS_FUNNEL = f"""WITH t AS (SELECT text, {S.tokens('text')} AS tokens, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM (SELECT doc_id, {TX} AS text FROM documents))
 SELECT count(*) AS docs_before, count(*) FILTER (text = '') AS dropped_empty, count(*) FILTER (text <> '' AND n > 1) AS dropped_exact, count(*) FILTER (text <> '' AND n = 1) AS docs_after,
 sum(tokens) AS tokens_before, sum(tokens) FILTER (text <> '' AND n = 1) AS tokens_after FROM t"""


def _corpus_funnel(s, d):
    rows = docs(s, d).select("doc_id", F.sha2("text", 256).alias("key"), (F.col("text") == "").alias("blank"), T.estimated_tokens(F.col("text")).cast("bigint").alias("tokens"))
    per = rows.groupBy("key").agg(F.max("blank").alias("blank"), F.count("*").alias("n"), F.max("tokens").alias("tokens"))
    full = ~F.col("blank")
    return per.agg(
        F.sum("n").alias("docs_before"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("dropped_empty"), F.sum(F.when(full, F.col("n") - 1).otherwise(0)).alias("dropped_exact"),
        F.count_if(full).alias("docs_after"), F.sum(F.col("tokens") * F.col("n")).alias("tokens_before"), F.sum(F.when(full, F.col("tokens"))).alias("tokens_after"),
    )


DEDUP_MANIFEST = f"""{{near}}, d AS (SELECT doc_id, {S.tokens(TX)} AS tokens, {S.strip(TX)} = '' AS blank FROM documents), t AS (SELECT d.*, coalesce(k.first = d.doc_id, false) AS head, d.doc_id IN (SELECT doc_id FROM ndrp) AS near FROM d LEFT JOIN k ON k.doc_id = d.doc_id)
 SELECT count(*) AS seen_docs, count(*) FILTER (blank) AS dropped_empty, count(*) FILTER (NOT blank AND NOT head) AS dropped_exact, count(*) FILTER (NOT blank AND head AND near) AS dropped_near,
 count(*) FILTER (NOT blank AND head AND NOT near) AS kept_docs, coalesce(sum(tokens) FILTER (NOT blank AND head AND NOT near), 0) AS kept_tokens FROM t"""


@query("sink_dedup_manifest", lambda: DEDUP_MANIFEST.replace("{near}", NEAR_CORPUS.replace("text <> ''", f"{S.strip(TX)} <> ''")))
def sink_dedup_manifest(s, d):
    """What the whole pass over the corpus - blank texts, exact copies, near copies - keeps and drops, as written to the shared folder and read again."""
    folder = ST.work_folder(s, "dedup-manifest")
    rows = docs(s, d).withColumn("blank", T.strip(F.col("text")) == "").withColumn("tokens", T.estimated_tokens(F.col("text")).cast("bigint"))
    classes = _near(rows.where("not blank"), None, whole=True)[0]
    firsts = O.first_wins(rows.where("not blank").select("doc_id", F.sha2("text", 256).alias("key")), ["key"], ["doc_id"]).select("doc_id", F.lit(True).alias("head"))
    marked = rows.select("doc_id", "blank", "tokens").join(classes.select("doc_id", "kept"), "doc_id", "left").join(firsts, "doc_id", "left").na.fill(False, ["kept", "head"])
    kept = F.col("kept")
    made = marked.agg(
        F.count("*").alias("seen_docs"), F.count_if("blank").alias("dropped_empty"), F.count_if(~F.col("blank") & ~F.col("head")).alias("dropped_exact"), F.count_if(F.col("head") & ~kept).alias("dropped_near"),
        F.count_if(kept).alias("kept_docs"), F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).alias("kept_tokens"),
    )
    sinks.write_json(made, folder)
    return s.read.schema(", ".join(f"{c} bigint" for c in made.columns)).json(folder)


query("a_funnel_corpus", CORPUS_FUNNEL)(_corpus_funnel)

@query("sink_dataset_manifest", lambda: f"WITH r AS (SELECT category, source, {REJECT} AS reason FROM sft_pool) SELECT 'counts' AS part, 'seen' AS name, count(*) AS n FROM r UNION ALL SELECT 'counts', 'kept', count(*) FROM r WHERE reason IS NULL UNION ALL SELECT 'rejected', reason, count(*) FROM r WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'final_categories', coalesce(category, '(none)'), count(*) FROM r WHERE reason IS NULL GROUP BY ALL UNION ALL SELECT 'final_sources', coalesce(source, '(none)'), count(*) FROM r WHERE reason IS NULL GROUP BY ALL")
def sink_dataset_manifest(s, d):
    """Counts, rejected rows by reason, and sources and categories of the kept ones, as written to the shared folder and read again; the pool is read once."""
    folder, none = ST.work_folder(s, "dataset-manifest"), F.lit("(none)")
    counts = cut(_reasons(s, d, "category").groupBy("reason", F.coalesce("category", none).alias("category"), F.coalesce("source", none).alias("source")).agg(F.count("*").alias("n")))
    kept = F.col("reason").isNull()
    of = lambda part, name: F.struct(F.lit(part).alias("part"), name.alias("name"))
    parts = F.array(of("counts", F.lit("seen")), F.when(kept, of("counts", F.lit("kept"))), F.when(~kept, of("rejected", F.col("reason"))), F.when(kept, of("final_categories", F.col("category"))), F.when(kept, of("final_sources", F.col("source"))))
    made = counts.select(F.explode(F.array_compact(parts)).alias("p"), "n").groupBy("p.part", "p.name").agg(F.sum("n").alias("n"))
    sinks.write_json(made, folder)
    return s.read.schema("part string, name string, n bigint").json(folder)


def scenarios(s: SparkSession, d: str) -> DataFrame:
    """A scenario of each pair with an instruction: its words as actions, risks, groups and points, missing lists where words are missing."""
    w = T.words(col_text("instruction"))
    some = lambda a, n: F.when(F.size("w") >= a, F.slice("w", a, n))
    rows = spread(table(s, d, "sft_pool")).select("pair_id", "category", w.alias("w")).where(F.size("w") > 0)
    return rows.select(F.col("pair_id").cast("string").alias("scenario_id"), F.col("category").alias("title"), some(1, 2).alias("priority_actions"), some(3, 2).alias("misinformation_risks"), some(5, 2).alias("vulnerable_groups"), some(7, 3).alias("coordination_points"))


def _qa_sql() -> str:
    nl = "chr(10)"
    part = lambda a, n: f"coalesce(w[{a}:{a + n - 1}], [])"
    marked = lambda x, mark: f"array_to_string(list_transform({x}, lambda x: {mark} || x), {nl})"
    numbered = f"array_to_string(list_transform({part(1, 2)}, lambda x, i: i::VARCHAR || '. ' || x), {nl})"
    rows = [
        ("priority", "'Apa prioritas pertama dalam skenario ' || title || '?'", f"{numbered} || {nl} || {nl} || 'Kelompok rentan: ' || array_to_string({part(5, 2)}, ', ') || '.' || {nl} || 'Koordinasi: ' || array_to_string({part(7, 3)}, ', ') || '.'"),
        ("misinformation", "'Bagaimana laporan pada skenario ' || title || ' disaring?'", f"'Risiko hoaks:' || {nl} || {marked(part(3, 2), S.q('- '))}"),
        ("coordination", "'Bagaimana koordinasi untuk skenario ' || title || '?'", marked(part(7, 3), S.q("- "))),
    ]
    base = f"s AS (SELECT pair_id::VARCHAR AS scenario_id, coalesce(category, '') AS title, {S.words(IN)} AS w FROM sft_pool)"
    return f"WITH {base} " + " UNION ALL ".join(f"SELECT scenario_id, '{k}' AS kind, {question} AS q, {a} AS a FROM s WHERE len(w) > 0" for k, question, a in rows)


@query("sink_scenario_pack", _qa_sql())
def sink_scenario_pack(s, d):
    folder = ST.work_folder(s, "scenarios")
    sinks.write_json_lines(A.scenario_questions(scenarios(s, d)), folder)
    return s.read.schema("scenario_id string, kind string, q string, a string").json(folder)


@query("sink_card", f"WITH {PAIRS}, n AS (SELECT coalesce(category, '(none)') AS part, count(*) AS n FROM p GROUP BY ALL) SELECT '# Dataset' || chr(10) || chr(10) || '| part | rows |' || chr(10) || '|---|---|' || chr(10) || array_to_string(list_sort(list('| ' || part || ' | ' || format('{{:,}}', n) || ' |')), chr(10)) || chr(10) AS card FROM n")
def sink_card(s, d):
    return sinks.card(pairs(s, d).groupBy(F.coalesce("category", F.lit("(none)")).alias("part")).agg(F.count("*").alias("n")))


@query("sink_eval_report", lambda: f"WITH d AS ({DELTA}), o AS ({SQL['a_eval_overall']}), f AS (SELECT '| ' || category || ' | ' || format('{{:.1f}}', round(score, 1)) || ' | ' || CASE WHEN delta IS NULL THEN '–' ELSE CASE WHEN round(delta, 1) >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', round(delta, 1)) END || ' |' AS line FROM d) SELECT '# Evaluation' || chr(10) || chr(10) || 'Overall: ' || (SELECT format('{{:.1f}}', round(overall, 1)) FROM o) || chr(10) || chr(10) || '| category | score | delta |' || chr(10) || '|---|---|---|' || chr(10) || array_to_string(list_sort(list(line)), chr(10)) || chr(10) AS report FROM f")
def sink_eval_report(s, d):
    return sinks.report(_delta(s, d), E.overall(E.by_category(_grades(s, d))).withColumn("overall", F.round("overall", 6)))


# ---------------------------------------------------------------- scalars

scalar("c_scrub", "documents", "doc_id", lambda: T.scrub(col_text()), S.scrub(TX))
scalar("c_clean_v1", "documents", "doc_id", lambda: T.clean(col_text()), S.clean(TX))
scalar("c_normalize", "sft_pool", "pair_id", lambda: T.normalize(col_text("output")), S.normalize(OUT))
scalar("c_simplify", "sft_pool", "pair_id", lambda: T.simplify(T.normalize(col_text("output"))), S.simplify(OUT))
scalar("c_truncate", "sft_pool", "pair_id", lambda: F.substring(T.strip(col_text("output")), 1, 500), f"substr({S.strip(OUT)}, 1, 500)")
scalar("c_est_tokens", "documents", "doc_id", lambda: T.estimated_tokens(col_text()), S.tokens(TX))
scalar("c_word_count", "documents", "doc_id", lambda: T.word_count(col_text()), S.n_words(TX))
scalar("c_mean_word_len", "documents", "doc_id", lambda: F.round(T.mean_word_length(col_text()), 9), f"round({S.mean_len(TX)}, 9)")
scalar("c_alpha_ratio", "documents", "doc_id", lambda: F.round(T.letter_share(col_text()), 9), f"round({S.letters(TX)}, 9)")
scalar("c_sha256_key", "documents", "doc_id", lambda: F.sha2(col_text(), 256), f"sha256({TX})")
scalar("c_md5_key", "sft_pool", "pair_id", lambda: F.md5(F.concat(col_text("instruction"), F.lit("|"), col_text("output"))), f"md5({IN} || '|' || {OUT})")
scalar("c_sha1_key", "sft_pool", "pair_id", lambda: F.sha1(F.concat(col_text("instruction"), F.lit("|"), col_text("output"))), f"sha1({IN} || '|' || {OUT})")
STRIPPED = f"substr(lower({S.strip('regexp_replace(' + IN + ', ' + S.q(f'(?i)^({T.TEMPLATES})[{S.BL}]+') + ', ' + S.q('') + ')')}), 1, 60)"
scalar("c_strip_template", "sft_pool", "pair_id", lambda: T.without_template(col_text("instruction")), STRIPPED)
TOPIC = f"substr({S.strip('regexp_replace(translate(' + IN + ', ' + S.q('?!') + ', ' + S.q('') + '), ' + S.q(f'^({T.TOPIC_VERBS})[{S.BL}]+') + ', ' + S.q('') + ')')}, 1, 80)"
scalar("c_topic", "sft_pool", "pair_id", lambda: T.topic(col_text("instruction")), TOPIC)


@query("c_line_counts", f"SELECT doc_id, {S.newlines(TX)} AS lines, round({S.ellipses(TX)} * {S.newlines(TX)})::INT AS ellipses, round({S.bullets(TX)} * {S.newlines(TX)})::INT AS bullets FROM documents")
def c_line_counts(s, d):
    return docs(s, d).select("doc_id", T.newline_count(F.col("text")).alias("lines"), T.ellipsis_lines(F.col("text")).alias("ellipses"), T.bullet_lines(F.col("text")).alias("bullets"))


def grams_query(name: str, n: int, short: bool) -> None:
    g = S.ngrams("w", n, short)

    @query(name, f"SELECT doc_id, len(g) AS n, g[1] AS first, md5(array_to_string(g, chr(10))) AS h FROM (SELECT doc_id, {g} AS g FROM (SELECT doc_id, {S.words(TX)} AS w FROM documents))")
    def run(s, d):
        words = docs(s, d).select("doc_id", T.words(F.col("text")).alias("w"))
        rows = words.select("doc_id", T.ngrams(F.col("w"), n, short).alias("g"))
        return rows.select("doc_id", F.size("g").alias("n"), F.get("g", F.lit(0)).alias("first"), F.md5(F.array_join("g", "\n")).alias("h"))


grams_query("c_shingles5", 5, False)
grams_query("c_shingles5_short", 5, True)
grams_query("c_ngrams13", 13, False)


@query("c_summary_pair", f"SELECT doc_id, {S.q(T.SUMMARY_PREFIX)} || substr({TX}, 1, 500) AS instruction, regexp_replace(substr({TX}, 1, 250), '(?s)\\.[^.]*$', '') || '.' AS output FROM documents WHERE length({TX}) > 200")
def c_summary_pair(s, d):
    a, b = T.summary_pair(F.col("text"))
    return docs(s, d).where(F.length("text") > 200).select("doc_id", a.alias("instruction"), b.alias("output"))


@query("c_parse_json_payload", f"WITH {PAIRS} SELECT pair_id, instruction, output AS response FROM p WHERE NOT contains(instruction || chr(10) || output, '```')")
def c_parse_json_payload(s, d):
    """Every row as a fenced payload; a fence inside ends it for the parser, so such rows give no pair."""
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("instruction", F.col("output").alias("response")))), F.lit("\n```"))
    return pairs(s, d).select("pair_id", F.explode(readers.payload_pairs(fenced)).alias("p")).select("pair_id", "p.*")


TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


@query("c_chat_render", f"SELECT conv_id, string_agg({TURN}, '' ORDER BY turn, role, text) || '<|im_start|>assistant' || chr(10) AS prompt FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL) GROUP BY conv_id")
def c_chat_render(s, d):
    return C.rendered(table(s, d, "conversations"), generation_prompt=True)


LAST = f"""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC NULLS LAST, text DESC NULLS LAST) AS back
 FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)) WHERE back <= 6 AND role IN ('user', 'assistant') AND {S.strip('text')} <> ''"""


@query("w_last_turns", LAST)
def w_last_turns(s, d):
    return C.last_turns(table(s, d, "conversations"))


@query("c_build_messages", f"WITH l AS ({LAST}) SELECT conv_id, 'system' AS role, 'Jawab dengan jelas.' AS content, -1 AS turn FROM (SELECT DISTINCT conv_id FROM l) UNION ALL SELECT conv_id, role, text, turn FROM l")
def c_build_messages(s, d):
    last = C.last_turns(table(s, d, "conversations")).select("conv_id", "role", F.col("text").alias("content"), "turn")
    system = last.select("conv_id").distinct().select("conv_id", F.lit("system").alias("role"), F.lit("Jawab dengan jelas.").alias("content"), F.lit(-1).cast("bigint").alias("turn"))
    return system.unionByName(last)


@query("c_render_answers", f"SELECT scenario_id, kind, a FROM ({_qa_sql()}) WHERE kind = 'priority'")
def c_render_answers(s, d):
    return A.scenario_questions(scenarios(s, d)).where("kind = 'priority'").select("scenario_id", "kind", "a")


@query("c_quality_round", f"WITH {PAIRS} SELECT pair_id, round(q, 3) AS rounded, floor(q * 10) / 10 AS bucket FROM (SELECT pair_id, {auto_score('instruction', 'output')} AS q FROM p)")
def c_quality_round(s, d):
    q = pairs(s, d).select("pair_id", R.quality_autopilot(F.col("instruction"), F.col("output")).alias("q"))
    return q.select("pair_id", F.round("q", 3).alias("rounded"), (F.floor(F.col("q") * 10) / 10).alias("bucket"))


scalar("c_preview", "sft_pool", "pair_id", lambda: F.concat(F.substring(col_text("output"), 1, 50), F.lit("...")), f"substr({OUT}, 1, 50) || '...'")


@query("c_math_fns", "SELECT event_id, round(abs(value), 6) AS a, round(exp(value / 1000), 6) AS e, round(0.5::DOUBLE * (1 + cos(pi() * (event_id % 100) / 100)), 6) AS lr, event_id % 7 AS m FROM events")
def c_math_fns(s, d):
    lr = F.lit(0.5) * (1 + F.cos(F.pi() * (F.col("event_id") % 100) / 100))
    return table(s, d, "events").select("event_id", F.round(F.abs("value"), 6).alias("a"), F.round(F.exp(F.col("value") / 1000), 6).alias("e"), F.round(lr, 6).alias("lr"), (F.col("event_id") % 7).alias("m"))


# ---------------------------------------------------------------- predicates


@query("f_gopher", f"WITH {S.SCRUBBED} SELECT doc_id, source, {S.gopher('text', 'min_words', 'max_words')} AS reason FROM scr WHERE text <> ''")
def f_gopher(s, d):
    # a condition on the verdict, which is made after the input is dealt to all cores; one on the text would be moved before that
    return K.filtered(K.sourced(table(s, d, "documents"), specs(s, d))).where("reason is null or reason = 'gopher'").select("doc_id", "source", F.col("gopher").alias("reason"))


chosen("f_g_words", "documents", "doc_id", lambda: T.word_count(col_text()).between(50, 100_000), f"{S.n_words(TX)} BETWEEN 50 AND 100000")
chosen("f_g_mean_wl", "documents", "doc_id", lambda: T.mean_word_length(col_text()).between(3, 10), f"{S.mean_len(TX)} BETWEEN 3 AND 10")
chosen("f_g_alpha", "documents", "doc_id", lambda: T.letter_share(col_text()) >= F.lit(0.6), f"{S.letters(TX)} >= 0.6::DOUBLE")
chosen("f_g_ellipsis", "documents", "doc_id", lambda: T.ellipsis_lines(col_text()) / T.newline_count(col_text()) <= F.lit(0.3), f"{S.ellipses(TX)} <= 0.3::DOUBLE")
chosen("f_g_bullet", "documents", "doc_id", lambda: T.bullet_lines(col_text()) / T.newline_count(col_text()) <= F.lit(0.9), f"{S.bullets(TX)} <= 0.9::DOUBLE")
chosen("f_g_topword", "documents", "doc_id", lambda: F.when(T.word_count(col_text()) >= 20, T.top_count(T.words(col_text())) / T.word_count(col_text()) > F.lit(0.3)), f"{S.n_words(TX)} >= 20 AND {S.top(S.words(TX))}::DOUBLE / {S.n_words(TX)} > 0.3::DOUBLE")
chosen("f_g_repeat10", "documents", "doc_id", lambda: T.repeats(col_text(), 10), S.repeats(TX, 10))
@query("f_lid", f"SELECT doc_id, {S.language(TX, LEXICONS)[0]} AS language FROM documents")
def f_lid(s, d):
    return docs(s, d).select("doc_id", readers.stopword_language(F.col("text"), LEXICONS).alias("language"))


STOPS = f"len(list_filter({S.words(f'lower({TX})')}, lambda x: list_contains({S.arr(R.STOPWORDS)}, x)))::DOUBLE / nullif({S.n_words(f'lower({TX})')}, 0)"
chosen("f_stopword_ratio", "documents", "doc_id", lambda: R.stopword_share(col_text()) > F.lit(0.05), f"{STOPS} > 0.05::DOUBLE")
chosen("f_hint_count2", "documents", "doc_id", lambda: R.lexicon_hits(col_text(), R.COMMON_WORDS) >= 2, f"{S.hits(TX, R.COMMON_WORDS)} >= 2")
INDO = f"len(list_intersect(list_distinct({S.words(S.simplify(OUT))}), {S.arr(R.HINTS)}))"
scalar("f_indo_score", "sft_pool", "pair_id", lambda: R.hint_score(T.simplify(T.normalize(col_text("output")))), INDO)
CODE = lambda x: "(" + " OR ".join(f"contains(lower({x}), {S.q(m)})" for m in R.CODE_MARKERS) + ")"
chosen("f_likely_code", "documents", "doc_id", lambda: R.likely_code(col_text()), CODE(TX))
chosen("f_badwords", "documents", "doc_id", lambda: R.bad_words(col_text()), S.whole_word(TX, "|".join(R.BAD_WORDS)))
chosen("f_badcontent", "documents", "doc_id", lambda: R.bad_content(col_text()), S.whole_word(TX, "|".join(R.BAD_CONTENT)))
IDENTITY = f"({'|'.join(R.IDENTITY_OPENERS)})[{S.BL}]+({'|'.join(R.IDENTITY_NAMES)})"
chosen("f_wrong_identity", "sft_pool", "pair_id", lambda: R.wrong_identity(col_text("output")), S.whole_word(OUT, IDENTITY))
META = f"regexp_matches({OUT}, {S.q('(?i)(' + '|'.join(R.META_PHRASES) + ')')})"
chosen("f_meta", "sft_pool", "pair_id", lambda: R.meta(col_text("output")), META)
chosen("f_repeat7", "documents", "doc_id", lambda: T.repeats(col_text(), 7), S.repeats(TX, 7))
UNIFIED = S.total([
    (f"length({IN}) >= 10", 0.15), (f"length({IN}) >= 25", 0.10), (f"length({OUT}) >= 40", 0.20), (f"length({OUT}) >= 120", 0.20), (f"length({OUT}) <= 2500", 0.10), (f"contains({OUT}, chr(10))", 0.10),
    (f"regexp_matches({OUT}, '[.:;]')", 0.05), (f"{INDO} >= 2 OR {CODE(OUT)}", 0.10), (S.repeats(OUT, 7), -0.25),
])
UNIFIED = f"greatest(0::DOUBLE, least({UNIFIED}, 1::DOUBLE))"
BOTH = f"({IN} || chr(10) || {OUT})"
REJECT = f"""CASE WHEN length({IN}) < 8 THEN 'instruction_too_short' WHEN length({OUT}) < 20 THEN 'response_too_short' WHEN length({OUT}) > 3200 THEN 'response_too_long'
 WHEN {S.whole_word(BOTH, '|'.join(R.BAD_CONTENT))} THEN 'bad_content' WHEN {S.whole_word(OUT, IDENTITY)} THEN 'wrong_identity' WHEN {META} THEN 'meta_response' WHEN {S.repeats(BOTH, 7)} THEN 'noisy_repetition'
 WHEN NOT {CODE(OUT)} AND {INDO} < 1 AND source IS DISTINCT FROM 'synthetic' THEN 'not_indonesian_enough' WHEN {UNIFIED} < 0.42::DOUBLE THEN 'low_quality' END"""


def _reasons(s, d, *more: str):
    """The simplified response is made once, before the expressions that use it."""
    rows = pairs(s, d).withColumn("simple", T.simplify(T.normalize(F.col("output"))))
    return rows.select("pair_id", "source", *more, R.reject_reason(F.col("instruction"), F.col("output"), F.col("source"), F.col("simple")).alias("reason"))


@query("f_reject_reason", f"SELECT pair_id, {REJECT} AS reason FROM sft_pool")
def f_reject_reason(s, d):
    return _reasons(s, d).select("pair_id", "reason")


chosen("f_len_v1", "documents", "doc_id", lambda: F.length(T.clean(col_text())) >= 200, f"length({S.clean(TX)}) >= 200")
CONTAMINATED = f"""WITH bad AS (SELECT DISTINCT unnest({S.ngrams('w', 13)}) AS gram FROM (SELECT {S.words(TX)} AS w FROM benchmark)), own AS (SELECT doc_id, unnest({S.ngrams('w', 13)}) AS gram FROM (SELECT doc_id, {S.words(TX)} AS w FROM documents))"""


@query("f_decontam", f"{CONTAMINATED} SELECT DISTINCT doc_id FROM own WHERE gram IN (SELECT gram FROM bad)")
def f_decontam(s, d):
    return K.contaminated(docs(s, d), table(s, d, "benchmark"))


@query("j_decontam_anti", f"{CONTAMINATED} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM own WHERE gram IN (SELECT gram FROM bad))")
def j_decontam_anti(s, d):
    return docs(s, d).select("doc_id").join(K.contaminated(docs(s, d), table(s, d, "benchmark")), "doc_id", "left_anti")


def auditor_score(i: str, o: str) -> str:
    i, o = S.strip(i), S.strip(o)
    n, h = f"length({o})", S.hits(o, R.MORE_COMMON_WORDS)
    sent = f"list_filter(list_transform(string_split({o}, '.'), lambda x: {S.strip('x')}), lambda x: x <> '')"
    unique = f"(CASE WHEN len({sent}) > 1 THEN len(list_distinct({sent}))::DOUBLE / len({sent}) END)"
    w = S.words(f"lower({o})")
    template = "(" + " OR ".join(f"starts_with({i}, {S.q(t)})" for t in R.TEMPLATE_STARTS) + ")"
    s = S.total([
        (f"{n} > 3000", -0.1), (f"{n} > 50", 0.1), (f"{n} > 100", 0.1), (f"{n} > 200", 0.05), (f"length({i}) > 15", 0.1), (f"contains({i}, '?') OR contains({i}, '!')", 0.05), (f"{h} >= 3", 0.15), (f"{h} >= 5", 0.1), (f"{h} >= 8", 0.05),
        (f"len({sent}) >= 2", 0.1), (f"len({sent}) >= 3", 0.05), (f"{unique} > 0.7::DOUBLE", 0.1), (f"{unique} < 0.3::DOUBLE", -0.2), (f"contains({o}, '.')", 0.03), (f"contains({o}, ',')", 0.02),
        (f"len({w}) > 10 AND {S.top(w)}::DOUBLE / len({w}) * 100 > 30", -0.2), (f"{template} AND {n} < 100", -0.15),
    ])
    zero = f"{n} < 30 OR length({i}) < 8 OR {S.whole_word(f'{i} || chr(32) || {o}', '|'.join(R.BAD_WORDS))}"
    return f"CASE WHEN {zero} THEN 0::DOUBLE ELSE greatest(least({s}, 1::DOUBLE), 0::DOUBLE) END"


@query("f_dpo_clean", f"WITH p AS (SELECT pair_id, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected FROM dpo_pool) SELECT pair_id FROM p WHERE length(prompt) >= 5 AND length(chosen) >= 20 AND length(rejected) >= 5 AND chosen <> rejected AND length(chosen) >= length(rejected) * 0.5::DOUBLE AND {auditor_score('prompt', 'chosen')} >= 0.3::DOUBLE")
def f_dpo_clean(s, d):
    rows = spread(table(s, d, "dpo_pool").select("pair_id", *(col_text(c).alias(c) for c in ("prompt", "chosen", "rejected"))))
    return R.preference_clean(rows).select("pair_id")


chosen("f_sft_train", "sft_pool", "pair_id", lambda: (F.col("instruction") != "") & (F.length("output") > 20), "instruction <> '' AND length(output) > 20")
chosen("f_nonempty_pair", "sft_pool", "pair_id", lambda: (F.col("instruction") != "") & (F.col("output") != ""), "instruction <> '' AND output <> ''")
chosen("f_seed_len", "sft_pool", "pair_id", lambda: F.length(T.normalize(col_text("output"))) >= 120, f"length({S.normalize(OUT)}) >= 120")

# ---------------------------------------------------------------- scores

scalar("s_quality_autopilot", "sft_pool", "pair_id", lambda: R.quality_autopilot(col_text("instruction"), col_text("output")), auto_score(IN, OUT), "score")
@query("s_quality_auditor", f"SELECT pair_id, {auditor_score(IN, OUT)} AS score FROM sft_pool")
def s_quality_auditor(s, d):
    return audited(s, d).select("pair_id", "score")


scalar("s_quality_unified", "sft_pool", "pair_id", lambda: R.quality_unified(col_text("instruction"), col_text("output"), T.simplify(T.normalize(col_text("output")))), UNIFIED, "score")

ANSWERS = f"""ans AS (SELECT pair_id, coalesce(category, '(none)') AS category, 1.0::DOUBLE + length(coalesce(category, '(none)')) % 3 AS weight, {OUT} AS answer, list_filter({S.words(f'lower({IN})')}, lambda x: length(x) > 5) AS must, ['maaf', 'sorry', 'null'] AS must_not, 20 AS min_length FROM sft_pool)"""
GRADED = f"""{ANSWERS}, gr AS (SELECT *, list_filter([
  CASE WHEN len(must) > 0 AND NOT list_bool_or(list_transform(must, lambda k: contains(lower(answer), lower(k)))) THEN 'missing keywords' END,
  CASE WHEN len(list_filter(must_not, lambda k: contains(lower(answer), lower(k)))) > 0 THEN 'contains: ' || array_to_string(list_filter(must_not, lambda k: contains(lower(answer), lower(k))), ', ') END,
  CASE WHEN min_length > 0 AND length(answer) < min_length THEN 'too short' END, CASE WHEN length({S.strip('answer')}) < 5 THEN 'empty' END], lambda r: r IS NOT NULL) AS reasons FROM ans)"""


def _grades(s, d):
    none = F.lit("(none)")
    rows = pairs(s, d).select("pair_id", F.coalesce("category", none).alias("category"), F.col("output").alias("answer"), F.filter(T.words(F.lower("instruction")), lambda x: F.length(x) > 5).alias("must"))
    rows = rows.withColumn("weight", F.lit(1.0) + F.length("category") % 3).withColumn("must_not", F.array(*map(F.lit, ("maaf", "sorry", "null")))).withColumn("min_length", F.lit(20))
    return E.graded(rows)


@query("s_keyword_grade", f"WITH {GRADED} SELECT pair_id, len(reasons) = 0 AS pass, array_to_string(reasons, '; ') AS reasons FROM gr")
def s_keyword_grade(s, d):
    return _grades(s, d).select("pair_id", "pass", F.array_join("reasons", "; ").alias("reasons"))


PIECES = "len(regexp_extract_all({0}, '[A-Za-z0-9]+|[^A-Za-z0-9]'))"
FERT = f"SELECT coalesce(lang, '(none)') AS lang, sum({PIECES.format(TX)}) AS tokens, sum({S.n_words(TX)}) AS words, round(CASE WHEN sum({S.n_words(TX)}) > 0 THEN sum({PIECES.format(TX)})::DOUBLE / sum({S.n_words(TX)}) ELSE 0 END, 9) AS fertility FROM documents GROUP BY ALL"


@query("a_fert_lang", FERT)
def a_fert_lang(s, d):
    rows = docs(s, d).select(F.coalesce("lang", F.lit("(none)")).alias("lang"), T.piece_count(F.col("text")).alias("n_tokens"), T.word_count(F.col("text")).alias("n_words"))
    return E.fertility(rows, ["lang"]).withColumn("fertility", F.round("fertility", 9))


@query("s_fertility", f"SELECT doc_id, round(CASE WHEN {S.n_words(TX)} > 0 THEN {PIECES.format(TX)}::DOUBLE / {S.n_words(TX)} ELSE 0 END, 9) AS fertility FROM documents")
def s_fertility(s, d):
    n = T.word_count(F.col("text"))
    return docs(s, d).select("doc_id", F.round(F.when(n > 0, T.piece_count(F.col("text")) / n).otherwise(F.lit(0.0)), 9).alias("fertility"))


@query("s_perplexity", "SELECT event_type, round(exp(sum(value / 100 * (event_id % 50)) / nullif(sum(event_id % 50), 0)), 6) AS perplexity FROM events GROUP BY event_type")
def s_perplexity(s, d):
    rows = table(s, d, "events").select("event_type", (F.col("value") / 100).alias("loss"), (F.col("event_id") % 50).alias("n_tokens"))
    return E.perplexity(rows, ["event_type"]).withColumn("perplexity", F.round("perplexity", 6))


# ---------------------------------------------------------------- duplicates


@query("d_exact_global", f"WITH {S.SCRUBBED} SELECT source, doc_id, copies FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS r, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM scr WHERE text <> '') WHERE r = 1")
def d_exact_global(s, d):
    rows = K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "source", T.scrub(F.col("text")).alias("text")).where("text <> ''")
    return D.exact(rows, F.sha2("text", 256), ["source", "doc_id"]).select("source", "doc_id", "copies")


@query("d_exact_corpus", f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE {TX} <> '' GROUP BY sha256(text)")
def d_exact_corpus(s, d):
    return D.exact(docs(s, d).where("text <> ''"), F.sha2("text", 256), ["doc_id"]).select("doc_id", "copies")


@query("d_exact_v1", f"WITH t AS (SELECT doc_id, {S.clean(TX)} AS text FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM t WHERE length(text) >= 200 GROUP BY md5(text)")
def d_exact_v1(s, d):
    rows = docs(s, d).select("doc_id", T.clean(F.col("text")).alias("text")).where(F.length("text") >= 200)
    return D.exact(rows, F.md5("text"), ["doc_id"]).select("doc_id", "copies")


def _near(rows: DataFrame, group: Column | None, whole: bool) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``kept``, ``class_id`` of every row, and the similar pairs of a kept text and another one.

    Exact copies have equal shingles, so only the first of each is compared; the others follow it.
    """
    grp = (F.lit("") if group is None else group).alias("grp")
    keyed = cut(rows.select("doc_id", grp, F.unhex(F.sha2("text", 256)).alias("key")))
    first = cut(O.first_wins(keyed, ["grp", "key"], ["doc_id"]).select("grp", "key", F.col("doc_id").alias("first")))
    decided, links = D.near_copies(rows.select(F.col("doc_id").alias("id"), grp, "text"), first.select(F.col("first").alias("id")), D.shingle_sets(whole)(F.col("text")))
    own = decided.join(links.groupBy("id").agg(F.min("first").alias("class_id")), "id", "left").select(F.col("id").alias("first"), "kept", F.coalesce("class_id", "id").alias("class_id"))
    members = keyed.join(first, ["grp", "key"]).join(own, "first")
    return members.select("doc_id", (F.col("kept") & (F.col("doc_id") == F.col("first"))).alias("kept"), "class_id"), links


NEAR_CLASSES = "cls AS (SELECT b, min(a) AS lead FROM nprs WHERE a NOT IN (SELECT doc_id FROM ndrp) GROUP BY b), nearest AS (SELECT k.doc_id, k.doc_id = k.first AND k.first NOT IN (SELECT doc_id FROM ndrp) AS kept, CASE WHEN k.first IN (SELECT doc_id FROM ndrp) THEN cls.lead ELSE k.first END AS class_id FROM k LEFT JOIN cls ON cls.b = k.first)"
NEAR_SOURCE = f"WITH RECURSIVE {S.SOURCED}, k AS MATERIALIZED (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY source, text) AS first FROM src WHERE text <> ''), h AS MATERIALIZED (SELECT doc_id, source AS grp, {S.words('text')} AS w FROM k WHERE doc_id = first), {S.near('n', 'h', False)}, {NEAR_CLASSES}"
NEAR_CORPUS = f"WITH RECURSIVE k AS MATERIALIZED (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text <> ''), h AS MATERIALIZED (SELECT doc_id, '' AS grp, {S.words('text')} AS w FROM k WHERE doc_id = first), {S.near('n', 'h', True)}, {NEAR_CLASSES}"


@query("d_minhash_source", f"{NEAR_SOURCE} SELECT * FROM nearest")
def d_minhash_source(s, d):
    rows = K.sourced(table(s, d, "documents"), specs(s, d)).where("text <> ''")
    return _near(rows, F.col("source"), whole=False)[0]


@query("d_minhash_corpus", f"{NEAR_CORPUS} SELECT * FROM nearest")
def d_minhash_corpus(s, d):
    return _near(docs(s, d).where("text <> ''"), None, whole=True)[0]


def two_keys(exact: str, fuzzy: str, source: str = PAIRS) -> str:
    return f"""WITH {source}, k AS (SELECT pair_id, {exact} AS e, {fuzzy} AS f FROM p), x AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY pair_id) = 1 AS first FROM k),
     y AS (SELECT *, first AND row_number() OVER (PARTITION BY first, f ORDER BY pair_id) = 1 AS kept FROM x) SELECT pair_id, kept, CASE WHEN NOT first THEN 'exact' WHEN NOT kept THEN 'fuzzy' END AS reason FROM y"""


FUZZY = STRIPPED.replace(IN, "instruction")


@query("d_pair_auditor", two_keys("md5(instruction || '|' || output)", f"md5({FUZZY} || '|' || lower(substr(output, 1, 50)))"))
def d_pair_auditor(s, d):
    i, o = F.col("instruction"), F.col("output")
    fuzzy = F.md5(F.concat(T.without_template(i), F.lit("|"), F.lower(F.substring(o, 1, 50))))
    return D.by_two_keys(pairs(s, d), F.md5(F.concat(i, F.lit("|"), o)), fuzzy, "pair_id")


SIMPLE = f"p AS (SELECT pair_id, {S.simplify(IN)} AS i, {S.simplify(OUT)} AS o FROM sft_pool)"


@query("d_pair_unified", two_keys("sha1(i || '|' || o)", "sha1(substr(i, 1, 160) || '|' || substr(o, 1, 220))", SIMPLE))
def d_pair_unified(s, d):
    rows = pairs(s, d).select("pair_id", T.simplify(T.normalize(F.col("instruction"))).alias("i"), T.simplify(T.normalize(F.col("output"))).alias("o"))
    return D.by_two_keys(rows, F.sha1(F.concat("i", F.lit("|"), "o")), F.sha1(F.concat(F.substring("i", 1, 160), F.lit("|"), F.substring("o", 1, 220))), "pair_id")


@query("d_pair_autopilot", f"WITH {PAIRS} SELECT min(pair_id) AS pair_id, count(*) AS copies FROM p GROUP BY md5(lower(substr(instruction, 1, 80) || '|' || substr(output, 1, 50)))")
def d_pair_autopilot(s, d):
    key = F.md5(F.lower(F.concat(F.substring("instruction", 1, 80), F.lit("|"), F.substring("output", 1, 50))))
    return D.exact(pairs(s, d), key, ["pair_id"]).select("pair_id", "copies")


@query("d_seed", f"WITH t AS (SELECT pair_id, {S.normalize(OUT)} AS t FROM sft_pool) SELECT min(pair_id) AS pair_id, count(*) AS copies FROM t WHERE length(t) >= 120 GROUP BY sha1({S.simplify('substr(t, 1, 800)')})")
def d_seed(s, d):
    rows = pairs(s, d).select("pair_id", T.normalize(F.col("output")).alias("t")).where(F.length("t") >= 120)
    return D.exact(rows, F.sha1(T.simplify(T.normalize(F.substring("t", 1, 800)))), ["pair_id"]).select("pair_id", "copies")


# ---------------------------------------------------------------- aggregates


DROPPED = ", ".join(f"count(*) FILTER (reason = '{r}') AS dropped_{r}" for r in K.REASONS)


FUNNEL = f"SELECT source, count(*) AS seen_docs, count(*) FILTER (reason IS NULL) AS kept_docs, coalesce(sum(tokens) FILTER (reason IS NULL), 0) AS kept_tokens, {DROPPED} FROM staged GROUP BY source"


@query("a_funnel_source", f"WITH RECURSIVE {STAGED} {FUNNEL}")
def a_funnel_source(s, d):
    return K.funnel(staged(s, d))


TARGETS = f"tar AS (SELECT bucket, floor({TOTAL} * m / sum(m) OVER ())::BIGINT AS target_tokens FROM (SELECT bucket, (share_min + share_max) / 2::DOUBLE AS m FROM mix_config WHERE bucket IS NOT NULL))"


@query("a_bucket_targets", f"WITH {S.REGISTRY}, {TARGETS} SELECT source, bucket, target_tokens // count(*) OVER (PARTITION BY bucket) AS budget FROM reg JOIN tar USING (bucket)")
def a_bucket_targets(s, d):
    return K.source_budgets(specs(s, d), K.bucket_targets(table(s, d, "mix_config"), TOTAL))


@query("a_reject_counts", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT {REJECT} AS reason FROM sft_pool) GROUP BY ALL")
def a_reject_counts(s, d):
    return _reasons(s, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("a_source_counts", "SELECT source, count(*) AS n FROM sft_pool GROUP BY source")
def a_source_counts(s, d):
    return pairs(s, d).groupBy("source").agg(F.count("*").alias("n"))


@query("a_category_counts", "SELECT category, count(*) AS n FROM sft_pool GROUP BY category")
def a_category_counts(s, d):
    return pairs(s, d).groupBy("category").agg(F.count("*").alias("n"))


@query("a_score_hist", f"WITH h AS (SELECT floor(({auditor_score(IN, OUT)}) * 10) / 10 AS bucket, count(*) AS n FROM sft_pool GROUP BY ALL) SELECT bucket, n, floor(n::DOUBLE / max(n) OVER () * 30)::INT AS bar FROM h")
def a_score_hist(s, d):
    q = audited(s, d).select((F.floor(F.col("score") * 10) / 10).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return q.select("bucket", "n", F.floor(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))) * 30).cast("int").alias("bar"))


@query("a_audit_summary", f"WITH {PAIRS}, g AS (SELECT *, {auditor_score('instruction', 'output')} >= 0.45::DOUBLE AS good FROM p) SELECT count(*) AS before, count(*) FILTER (good) AS after, round(100 - 100.0::DOUBLE * count(*) FILTER (good) / count(*), 6) AS reduction, round(avg(length(instruction)) FILTER (good), 6) AS mean_instruction, round(avg(length(output)) FILTER (good), 6) AS mean_output FROM g")
def a_audit_summary(s, d):
    g = audited(s, d).withColumn("good", F.col("score") >= F.lit(R.MIN_QUALITY_AUDITOR))
    good = lambda c: F.round(F.avg(F.when(F.col("good"), F.length(c))), 6)
    return g.agg(F.count("*").alias("before"), F.count_if("good").alias("after"), F.round(100 - F.lit(100.0) * F.count_if("good") / F.count("*"), 6).alias("reduction"), good("instruction").alias("mean_instruction"), good("output").alias("mean_output"))


SHARES = "SELECT source, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM sft_pool WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT {}"


def _share_top(s, d, k: int) -> DataFrame:
    counts = pairs(s, d).where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("source", "n", F.round(F.col("n") * F.lit(100.0) / total, 6).alias("share")).orderBy(F.desc("n"), "source").limit(k)


query("a_source_share_topk", SHARES.format(15))(lambda s, d: _share_top(s, d, 15))
query("k_top_sources", SHARES.format(10))(lambda s, d: _share_top(s, d, 10))


@query("a_manifest_tokens", f"WITH RECURSIVE {STAGED} SELECT coalesce(sum(tokens), 0) AS tokens, coalesce(sum(tokens), 0) >= 100000 AS enough FROM staged WHERE reason IS NULL")
def a_manifest_tokens(s, d):
    kept = staged(s, d).where("reason is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return kept.select("tokens", (F.col("tokens") >= 100_000).alias("enough"))


@query("f_preflight_gates", lambda: f"WITH RECURSIVE {STAGED}, k AS (SELECT coalesce(sum(tokens), 0) AS n FROM staged WHERE reason IS NULL) SELECT 'corpus' AS gate, true AS passed, '1 files or more' AS detail UNION ALL SELECT 'missing', false, 'no file' UNION ALL SELECT 'tokens', n >= 100000, n::VARCHAR FROM k UNION ALL SELECT 'config', abs(sum((share_min + share_max) / 2::DOUBLE) - 1) < 0.05::DOUBLE, count(*)::VARCHAR FROM mix_config WHERE bucket IS NOT NULL UNION ALL SELECT 'output', true, 'written and read'")
def f_preflight_gates(s, d):
    """The gates before a run: files that a pattern matches (and one that matches none), enough kept tokens, shares of the configuration that make a whole, an output folder that takes files."""
    files = lambda pattern: readers.matched_files(s, f"{d}/{pattern}") > 0
    kept = staged(s, d).where("reason is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"))
    mix = table(s, d, "mix_config").where("bucket is not null").agg(F.sum((F.col("share_min") + F.col("share_max")) / F.lit(2.0)).alias("share"), F.count("*").alias("n"))
    folder = ST.work_folder(s, "probe")
    s.createDataFrame([("ok",)], "value string").write.text(folder)
    rows = [("corpus", files("documents.parquet*"), "1 files or more"), ("missing", files("none-*.parquet"), "no file"), ("output", s.read.text(folder).first()["value"] == "ok", "written and read")]
    made = s.createDataFrame(rows, "gate string, passed boolean, detail string")
    made = made.unionByName(kept.select(F.lit("tokens").alias("gate"), (F.col("n") >= 100_000).alias("passed"), F.col("n").cast("string").alias("detail")))
    return made.unionByName(mix.select(F.lit("config").alias("gate"), (F.abs(F.col("share") - 1) < F.lit(0.05)).alias("passed"), F.col("n").cast("string").alias("detail")))


@query("a_realised_mix", f"WITH RECURSIVE {STAGED}, m AS (SELECT bucket, sum(tokens) AS tokens FROM staged WHERE reason IS NULL GROUP BY bucket) SELECT c.bucket, coalesce(tokens, 0) AS tokens, round(coalesce(tokens, 0)::DOUBLE / (SELECT sum(tokens) FROM m), 9) AS share, coalesce(tokens, 0)::DOUBLE / (SELECT sum(tokens) FROM m) BETWEEN share_min AND share_max AS within FROM mix_config c LEFT JOIN m ON c.bucket = m.bucket WHERE c.bucket IS NOT NULL")
def a_realised_mix(s, d):
    mix = table(s, d, "mix_config").where("bucket is not null").select("bucket", "share_min", "share_max")
    real = staged(s, d).where("reason is null").groupBy("bucket").agg(F.sum("tokens").alias("tokens"))
    joined = mix.join(real, "bucket", "left").na.fill(0, ["tokens"])
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("s", share).select("bucket", "tokens", F.round("s", 9).alias("share"), F.col("s").between(F.col("share_min"), F.col("share_max")).alias("within"))


CATEGORY = "cat AS (SELECT category, count(*) FILTER (len(reasons) = 0) AS correct, count(*) AS total, count(*) FILTER (len(reasons) = 0) * 100.0::DOUBLE / count(*) AS score, max(weight) AS weight FROM gr GROUP BY category)"


@query("a_eval_category", f"WITH {GRADED}, {CATEGORY} SELECT category, correct, total, round(score, 6) AS score, weight FROM cat")
def a_eval_category(s, d):
    return E.by_category(_grades(s, d)).withColumn("score", F.round("score", 6))


@query("a_eval_overall", f"WITH {GRADED}, {CATEGORY} SELECT round(sum(score * weight) / greatest(sum(weight), 1), 6) AS overall FROM cat")
def a_eval_overall(s, d):
    return E.overall(E.by_category(_grades(s, d))).withColumn("overall", F.round("overall", 6))


DELTA = f"WITH {GRADED}, {CATEGORY}, base AS (SELECT category, 100.0::DOUBLE * count(*) FILTER (min_length > 0 AND length(answer) >= 100) / count(*) AS score FROM gr WHERE category <> 'umum' GROUP BY category) SELECT cat.category, round(cat.score, 6) AS score, round(base.score, 6) AS base_score, round(cat.score - base.score, 6) AS delta FROM cat LEFT JOIN base USING (category)"


def _delta(s, d):
    g = _grades(s, d)
    base = g.where("category <> 'umum'").groupBy("category").agg((F.lit(100.0) * F.count_if(F.length("answer") >= 100) / F.count("*")).alias("score"))
    return E.delta(E.by_category(g), base).select("category", *(F.round(c, 6).alias(c) for c in ("score", "base_score", "delta")))


query("a_eval_delta", DELTA)(_delta)
@query("j_eval_base", f"WITH {GRADED}, base AS (SELECT category, count(*) AS n FROM gr WHERE category <> 'umum' GROUP BY category) SELECT pair_id, gr.category, base.n IS NOT NULL AS found, coalesce(base.n, 0) AS base_answers FROM gr LEFT JOIN base USING (category)")
def j_eval_base(s, d):
    """Every answer with the base's row of its category, 0 where the base lacks it; the base has a row per category."""
    g = _grades(s, d)
    base = g.where("category <> 'umum'").groupBy("category").agg(F.count("*").alias("n"))
    return g.join(broadcast_small(base), "category", "left").select("pair_id", "category", F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("base_answers"))


@query("a_top_word", f"SELECT doc_id, {S.top('w')} AS top, round({S.top('w')}::DOUBLE / len(w), 9) AS share FROM (SELECT doc_id, {S.words(TX)} AS w FROM documents) WHERE len(w) > 0")
def a_top_word(s, d):
    rows = docs(s, d).select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0).select("doc_id", T.top_count(F.col("w")).alias("top"), F.size("w").alias("n"))
    return rows.select("doc_id", "top", F.round(F.col("top") / F.col("n"), 9).alias("share"))


# ---------------------------------------------------------------- order

KEPT = "kept AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, source, reason, CASE WHEN reason IS NULL THEN tokens ELSE 0 END AS tokens FROM staged))"


@query("w_token_budget", f"WITH RECURSIVE {STAGED}, {KEPT} SELECT doc_id, source, tokens FROM kept WHERE before < 5000 AND reason IS NULL")
def w_token_budget(s, d):
    rows = staged(s, d).withColumn("tokens", F.when(F.col("reason").isNull(), F.col("tokens")).otherwise(F.lit(0)))
    return O.within_budget(rows, ["source"], "doc_id", F.col("tokens"), F.lit(5000)).where("reason is null").select("doc_id", "source", "tokens")


@query("w_max_docs", f"WITH {S.SOURCED} SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM src) WHERE n <= 25")
def w_max_docs(s, d):
    return O.first_rows(K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "source"), ["source"], "doc_id", 25)


def running(bytes_sql: str, limit: int, source: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key} FROM (SELECT {key}, coalesce(sum({bytes_sql}) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}) WHERE before < {limit}"


JSON_BYTES = f"octet_length(encode(CASE WHEN source IS NULL THEN json_object('text', {TX}) ELSE json_object('text', {TX}, 'source', source) END::VARCHAR))"


@query("w_byte_budget", running(JSON_BYTES, 200_000))
def w_byte_budget(s, d):
    rows = docs(s, d).select("doc_id", F.octet_length(F.to_json(F.struct("text", "source"))).alias("size"))
    return O.within_budget(rows, [], "doc_id", F.col("size"), F.lit(200_000)).select("doc_id")


@query("w_max_bytes", running(f"octet_length(encode({TX}))", 200_000))
def w_max_bytes(s, d):
    rows = docs(s, d).select("doc_id", F.octet_length("text").alias("size"), F.lit(0).alias("all"))
    return O.within_budget(rows, ["all"], "doc_id", F.col("size"), F.lit(200_000)).select("doc_id")


@query("ord_shard_id", f"WITH {S.SOURCED} SELECT doc_id, source, floor(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 50000)::INT AS shard FROM src")
def ord_shard_id(s, d):
    rows = K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "source", F.length("text").alias("n"))
    return sinks.shard_numbers(rows, ["source"], "doc_id", F.col("n"), 50_000).select("doc_id", "source", "shard")


@query("w_first_wins", f"WITH {S.SOURCED} SELECT source, text = '' AS blank, min(doc_id) AS doc_id, count(*) AS copies FROM src GROUP BY ALL")
def w_first_wins(s, d):
    rows = K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "source", (F.col("text") == "").alias("blank"))
    return O.first_wins(rows, ["source", "blank"], ["doc_id"])


REBALANCED = f"WITH {PAIRS}, r AS (SELECT *, category = 'pertanian' AS para FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(para, false) ORDER BY length(output) DESC, pair_id) AS k FROM r), kept AS (SELECT pair_id, coalesce(para, false) AS para FROM n WHERE NOT coalesce(para, false) OR k <= (SELECT floor(count(*) * 0.2::DOUBLE) FROM p))"


def _rebalanced(s, d) -> tuple[DataFrame, DataFrame]:
    """The best of the category, at most a fifth of all rows, and the rows of the others."""
    rows = cut(pairs(s, d).select("pair_id", F.length("output").alias("n"), F.coalesce(F.col("category") == "pertanian", F.lit(False)).alias("para")))
    ranked = rows.where("para").select("pair_id", "para", F.struct((-F.col("n")).alias("n"), F.col("pair_id").alias("id")).alias("place"))
    return O.first_rows(ranked, ["para"], "place", int(rows.count() * 0.2)).select("pair_id", "para"), rows.where("not para").select("pair_id", "para")


@query("k_rebalance", f"{REBALANCED} SELECT pair_id FROM kept WHERE para")
def k_rebalance(s, d):
    return _rebalanced(s, d)[0].select("pair_id")


@query("k_best15000", f"WITH {PAIRS} SELECT pair_id, length(output) AS n FROM p ORDER BY n DESC, pair_id LIMIT 15000")
def k_best15000(s, d):
    return pairs(s, d).select("pair_id", F.length("output").alias("n")).orderBy(F.desc("n"), "pair_id").limit(15_000)


@query("k_source_cap", f"WITH {PAIRS} SELECT pair_id FROM (SELECT pair_id, row_number() OVER (PARTITION BY category ORDER BY pair_id) AS n FROM p WHERE length(output) > 50) WHERE n <= 40")
def k_source_cap(s, d):
    return O.first_rows(pairs(s, d).where(F.length("output") > 50).select("pair_id", "category"), ["category"], "pair_id", 40).select("pair_id")


@query("k_limit", "SELECT pair_id FROM sft_pool ORDER BY pair_id LIMIT 500")
def k_limit(s, d):
    return pairs(s, d).select("pair_id").orderBy("pair_id").limit(500)


@query("o_sort_paths", "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL ORDER BY url")
def o_sort_paths(s, d):
    return table(s, d, "pages").where("url is not null").select("url").distinct().orderBy("url")


@query("o_shuffle", "SELECT pair_id, row_number() OVER (ORDER BY md5('42|' || pair_id), pair_id) - 1 AS place FROM sft_pool")
def o_shuffle(s, d):
    """A seeded order that is the same on every partitioning, by a hash of seed and id, with each row's place."""
    hashed = pairs(s, d).select("pair_id", F.struct(F.md5(F.concat(F.lit("42|"), F.col("pair_id").cast("string"))).alias("h"), "pair_id").alias("o"))
    return O.running_total(hashed, [], "o", F.lit(1), "place").select("pair_id", "place").orderBy("place")


@query("w_rolling_mean50", "SELECT event_id, round(avg(value) OVER w, 9) AS mean50, round(avg(CASE WHEN value < 50 THEN 1.0::DOUBLE ELSE 0 END) OVER w, 9) AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def w_rolling_mean50(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-49, 0)
    return table(s, d, "events").select("event_id", F.round(F.avg("value").over(w), 9).alias("mean50"), F.round(F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0)).over(w), 9).alias("low"))


@query("w_ema", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.98::DOUBLE + x * 0.02::DOUBLE), 6) AS ema FROM events WHERE value IS NOT NULL AND event_id IS NOT NULL GROUP BY user_id")
def w_ema(s, d):
    return O.moving_average(table(s, d, "events"), ["user_id"], "event_id", "value", 0.98, "ema").withColumn("ema", F.round("ema", 6))


# ---------------------------------------------------------------- joins and sets


@query("j_seen_anti", f"WITH {S.SOURCED} SELECT doc_id FROM src WHERE source = 'saring_id' AND sha256(text) NOT IN (SELECT sha256(text) FROM src WHERE source < 'saring_id')")
def j_seen_anti(s, d):
    rows = K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return rows.where("source = 'saring_id'").join(rows.where("source < 'saring_id'").select("key"), "key", "left_anti").select("doc_id")


@query("j_source_lookup", f"WITH {S.SOURCED} SELECT doc_id, source, bucket, language, min_words FROM src")
def j_source_lookup(s, d):
    return K.sourced(table(s, d, "documents"), specs(s, d)).select("doc_id", "source", "bucket", "language", "min_words")


KNOWN = (("pertanian", 100), ("umum", 50))


@query("j_known_lookup", "SELECT pair_id, most FROM sft_pool JOIN (VALUES ('pertanian', 100), ('umum', 50)) k(category, most) USING (category)")
def j_known_lookup(s, d):
    return pairs(s, d).join(F.broadcast(s.createDataFrame(KNOWN, "category string, most int")), "category").select("pair_id", "most")


@query("j_lsh_candidates", f"{NEAR_CORPUS} SELECT a AS first, b AS id FROM nprs WHERE a NOT IN (SELECT doc_id FROM ndrp)")
def j_lsh_candidates(s, d):
    """Pairs of a kept text and each different text that is similar to it; the classes of ``d_minhash_corpus`` name the members."""
    return _near(docs(s, d).where("text <> ''"), None, whole=True)[1]


@query("j_lexicon", f"SELECT doc_id, {S.hits(TX, R.MORE_COMMON_WORDS)} AS hits FROM documents")
def j_lexicon(s, d):
    return docs(s, d).select("doc_id", R.lexicon_hits(F.col("text"), R.MORE_COMMON_WORDS).alias("hits"))


LOADED = f"WITH {PAIRS}, {CHAT} SELECT 0 AS rank, pair_id AS ord, instruction, output AS response FROM p WHERE instruction <> '' AND output <> '' UNION ALL SELECT 1, u.conv_id, u.text, a.text FROM u JOIN a USING (conv_id)"


@query("u_loaders", LOADED)
def u_loaders(s, d):
    a = readers.instruction_rows(table(s, d, "sft_pool"), "pool").select(F.lit(0).alias("rank"), F.col("pair_id").alias("ord"), "instruction", "response")
    return a.unionByName(C.first_pairs(table(s, d, "conversations")).select(F.lit(1).alias("rank"), F.col("conv_id").alias("ord"), "instruction", "response"))


@query("u_base_synth", f"SELECT instruction, response, min(struct_pack(rank := rank, ord := ord)).rank AS rank, min(struct_pack(rank := rank, ord := ord)).ord AS ord, count(*) AS copies FROM ({LOADED}) GROUP BY ALL")
def u_base_synth(s, d):
    return O.first_wins(u_loaders(s, d), ["instruction", "response"], ["rank", "ord"])


@query("u_all_data", "SELECT 'sft' AS part, pair_id FROM sft_pool UNION ALL SELECT 'dpo', pair_id FROM dpo_pool")
def u_all_data(s, d):
    part = lambda name, t: table(s, d, t).select(F.lit(name).alias("part"), "pair_id")
    return part("sft", "sft_pool").unionByName(part("dpo", "dpo_pool"))


@query("u_rebalanced", f"{REBALANCED} SELECT pair_id, para FROM kept")
def u_rebalanced(s, d):
    best, others = _rebalanced(s, d)
    return best.unionByName(others)


@query("u_names", f"SELECT name, count(*) AS times FROM (SELECT hf_path AS name FROM source_registry WHERE hf_path IS NOT NULL UNION ALL SELECT unnest({S.arr(CURATED)})) GROUP BY name")
def u_names(s, d):
    """Names of both lists, each once, with how often they are named."""
    found = table(s, d, "source_registry").where("hf_path is not null").select(F.col("hf_path").alias("name"))
    return found.unionByName(s.createDataFrame([(n,) for n in CURATED], "name string")).groupBy("name").agg(F.count("*").alias("times"))




@query("u_ngrams", f"SELECT DISTINCT md5(unnest({S.ngrams('w', 13)})) AS gram FROM (SELECT {S.words(TX)} AS w FROM benchmark)")
def u_ngrams(s, d):
    words = table(s, d, "benchmark").select(T.words(col_text()).alias("w"))
    return words.select(F.explode(T.ngrams(F.col("w"), 13)).alias("g")).select(F.md5("g").alias("gram")).distinct()


@query("u_intersect", f"SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct({S.words(f'lower({TX})')}), {S.arr(R.HINTS)})), ' ') AS both FROM documents")
def u_intersect(s, d):
    """The words that a text and a lexicon have in common."""
    return docs(s, d).select("doc_id", F.array_join(F.array_sort(F.array_intersect(T.words(F.lower("text")), F.array(*map(F.lit, R.HINTS)))), " ").alias("both"))


chosen("u_split", "sft_pool", "pair_id", lambda: F.col("category") == "kebencanaan", "category = 'kebencanaan'")

# ---------------------------------------------------------------- generators

PICK = lambda xs, n: f"({S.arr(xs)})[({n} % {len(xs)} + 1)::INT]"
PARA = f"""WITH b AS (SELECT pair_id, {IN} AS instruction, {OUT} AS output, row_number() OVER (ORDER BY length({OUT}) DESC, pair_id) - 1 AS rank FROM sft_pool ORDER BY length({OUT}) DESC, pair_id LIMIT 15000),
 c AS (SELECT *, greatest(1, 200000 // (SELECT count(*) FROM b)) AS each FROM b), e AS (SELECT *, unnest(range(0, each)) AS copy FROM c)
 SELECT pair_id, copy, {PICK(A.PREFIXES, S.md5_int("pair_id::VARCHAR", "copy::VARCHAR", "'a'"))} || ' ' || {TOPIC.replace(IN, 'instruction')} || {PICK(A.SUFFIXES, S.md5_int("pair_id::VARCHAR", "copy::VARCHAR", "'b'"))} AS instruction, output FROM e WHERE rank * each + copy < 200000"""


@query("g_paraphrase", PARA)
def g_paraphrase(s, d):
    return A.paraphrases(table(s, d, "sft_pool"), "pair_id", 200_000)


def _math_sql(loops: int, seed: int = 7) -> str:
    draw = lambda place, n: f"({S.md5_int('loop::VARCHAR', S.q(str(seed)), S.q(place))} % {n})"
    word = lambda xs, place: f"({S.arr(xs)})[{draw(place, len(xs))} + 1]"
    base = f"""SELECT loop, {draw('x', 900)} + 100 AS x, {draw('y', 90)} + 10 AS y, ['+', '-', 'x'][{draw('sign', 3)} + 1] AS sign, {draw('stock', 200)} + 50 AS stock, {draw('gone', 50)} AS gone,
     {word(A.WORKERS, 'worker')} AS worker, {word(A.GOODS, 'good')} AS good, ({draw('whole', 40)} + 1) * 100 AS whole, ({draw('share', 19)} + 1) * 5 AS share, ({draw('price', 95)} + 5) * 250 AS price, {draw('many', 11)} + 2 AS many FROM range({loops}) t(loop)"""
    rows = [
        ("operation", "'Hitunglah ' || x || ' ' || sign || ' ' || y || '.'", "x || ' ' || sign || ' ' || y || ' = ' || CASE sign WHEN '+' THEN x + y WHEN '-' THEN x - y ELSE x * y END"),
        ("rest", "'Di gudang seorang ' || worker || ' ada ' || stock || ' ' || good || ', lalu ' || gone || ' terpakai. Tinggal berapa?'", "stock || ' - ' || gone || ' = ' || (stock - gone) || ' ' || good"),
        ("part", "'Tentukan ' || share || ' persen dari ' || whole || '.'", "whole || ' x ' || share || ' / 100 = ' || (whole * share // 100)"),
        ("cost", "'Satu dari ' || good || ' dijual ' || price || ' rupiah. Berapa harga ' || many || ' ' || good || '?'", "many || ' x ' || price || ' = ' || (many * price) || ' rupiah'"),
    ]
    return f"WITH b AS ({base}) " + " UNION ALL ".join(f"SELECT loop, '{k}' AS kind, {q} AS instruction, {a} AS output FROM b" for k, q, a in rows)


@query("g_math", _math_sql(750))
def g_math(s, d):
    return A.arithmetic(s, 750)


REPLIES = (("Siapa kamu?", "Saya asisten bahasa."), ("Halo!", "Halo! Ada yang bisa saya bantu?"), ("Kamu bisa apa saja?", "Saya bisa menjawab dan menulis."))


def _replicas(times: int):
    def run(s, d):
        return A.replicas(s.createDataFrame(REPLIES, "instruction string, output string"), times)

    return run


def _replica_sql(times: int) -> str:
    rows = ", ".join(f"({S.q(a)}, {S.q(b)})" for a, b in REPLIES)
    return f"SELECT instruction, output, unnest(range(0, {times}))::INT AS copy FROM (VALUES {rows}) t(instruction, output)"


query("g_identity", _replica_sql(500 // 8))(_replicas(500 // 8))
query("g_coding", _replica_sql(500 // 6))(_replicas(500 // 6))
query("g_identity30", _replica_sql(30))(_replicas(30))


def _few(least: int) -> str:
    w = S.words("chosen")
    return f"array_to_string({w}[1:greatest({least}, floor(len({w}) / 6)::INT)], ' ') || '...'"


HEAD = "string_split(chosen, '.')[1]"
WAYS8 = [f"{HEAD} || '.'", S.q(A.ENGLISH_ONLY), f"{S.q(A.OTHER_IDENTITY + ' ')} || substr(chosen, 1, 60)", f"{S.q(A.TOO_EASY)} || substr(chosen, 1, 50)", _few(3), f"repeat({HEAD} || '. ', 3)", S.q(A.NOT_UNDERSTOOD), "'Hmm ' || substr(chosen, 1, 30) || ' ya begitulah.'"]
WAYS6 = [S.q(A.NOT_KNOWN), S.q(A.OTHER_IDENTITY), _few(5), f"CASE WHEN contains(chosen, '.') THEN repeat({HEAD} || '. ', 2) ELSE substr(chosen, 1, 60) || '...' END", S.q(A.TOO_SHORT), S.q(A.ENGLISH_ANSWER)]


def spoiled(ways: list[str], least: int, least_rejected: int) -> str:
    n = f"{S.md5_int('pair_id::VARCHAR', S.q('spoil'))} % {len(ways)}"
    case = "CASE n " + " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(ways)) + " END"
    return f"WITH {PAIRS}, c AS (SELECT pair_id, instruction AS prompt, output AS chosen, {n} AS n FROM p WHERE length(output) >= {least}), r AS (SELECT pair_id, prompt, chosen, {case} AS rejected FROM c) SELECT * FROM r WHERE rejected <> chosen AND length(rejected) >= {least_rejected}"


@query("g_dpo_autopilot", spoiled(WAYS8, 30, 11))
def g_dpo_autopilot(s, d):
    return A.preference_pairs(pairs(s, d), "pair_id", A.corruptions(F.col("chosen")), 30, 11)


@query("g_dpo_unified", spoiled(WAYS6, 40, 10))
def g_dpo_unified(s, d):
    return A.preference_pairs(pairs(s, d), "pair_id", A.brief_corruptions(F.col("chosen")), 40, 10)


@query("g_scenario_qa", _qa_sql())
def g_scenario_qa(s, d):
    return A.scenario_questions(scenarios(s, d))


TEACHER = " UNION ALL ".join(f"SELECT pair_id, {k} AS k, {S.normalize('prompt')} AS instruction, {S.normalize(c)} AS response FROM d WHERE fenced" for k, c in enumerate(("chosen", "rejected")))


@query("g_explode_pairs", f"WITH c AS (SELECT pair_id, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected FROM dpo_pool), d AS (SELECT *, {FEW_FENCES.format('(prompt || chosen || prompt || rejected)')} AS fenced FROM c) SELECT * FROM ({TEACHER}) WHERE instruction <> '' AND response <> ''")
def g_explode_pairs(s, d):
    """Answers of a teacher with two pairs each, unwrapped, normalised and numbered; every row goes through the parser."""
    item = lambda c: F.struct(F.col("prompt").alias("instruction"), F.col(c).alias("response"))
    raw = F.to_json(F.struct(F.array(item("chosen"), item("rejected")).alias("items")))
    return A.teacher_pairs(spread(table(s, d, "dpo_pool")), "pair_id", raw)


# ---------------------------------------------------------------- tokens

WORD_IDS = f"list_transform({S.words(TX)}, lambda w: ('0x' || substr(md5(w), 1, 6))::INT % 50000 + 10)"
BOS, EOS, PAD, LENGTH = 1, 2, 0, 128


def _ids(s, d) -> DataFrame:
    """Word ids by a hash, a stand-in for a vocabulary that SQL can follow."""
    return docs(s, d).select("doc_id", F.transform(T.words(F.col("text")), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % 50000 + 10)).alias("ids"))


IDS = f"i AS (SELECT doc_id, {WORD_IDS} AS ids FROM documents)"
JOINED = lambda x: f"array_to_string({x}, ' ')"


def _listed(rows: DataFrame, key: str, *arrays: str) -> DataFrame:
    return rows.select(key, *(F.array_join(F.col(a).cast("array<string>"), " ").alias(a) for a in arrays))


@query("t_encode", f"WITH {IDS} SELECT doc_id, {JOINED(f'[{BOS}] || ids[1:{LENGTH - 2}] || [{EOS}]')} AS ids FROM i")
def t_encode(s, d):
    return _listed(_ids(s, d).select("doc_id", P.wrapped(F.col("ids"), BOS, EOS, LENGTH).alias("ids")), "doc_id", "ids")


VOCABULARY = f"v AS (SELECT token, min(word) AS word FROM (SELECT unnest(ids) AS token, unnest(w) AS word FROM (SELECT {WORD_IDS} AS ids, {S.words(TX)} AS w FROM documents)) GROUP BY token)"


@query("t_decode", f"WITH {IDS}, {VOCABULARY}, e AS (SELECT doc_id, ids[1:{LENGTH - 2}] AS ids FROM i), x AS (SELECT doc_id, unnest(ids) AS token, generate_subscripts(ids, 1) AS k FROM e), t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM x JOIN v USING (token) GROUP BY doc_id) SELECT doc_id, coalesce(text, '') AS text FROM e LEFT JOIN t USING (doc_id)")
def t_decode(s, d):
    """The encoded ids, with marks and padding, as text again, by the vocabulary of the words."""
    made = docs(s, d).select("doc_id", F.col("text"), T.words(F.col("text")).alias("w"))
    pairs_of = _ids(s, d).join(made.select("doc_id", "w"), "doc_id").select(F.explode(F.arrays_zip("ids", "w")).alias("p")).select(F.col("p.ids").alias("token"), F.col("p.w").alias("word"))
    encoded = _ids(s, d).select("doc_id", P.padded(P.wrapped(F.col("ids"), BOS, EOS, LENGTH), LENGTH, PAD).alias("ids"))
    return P.decoded(encoded, "doc_id", "ids", pairs_of, (BOS, EOS, PAD))


PADDED = lambda x, fill, n=LENGTH: f"({x})[1:{n}] || list_transform(range(0, greatest(0, {n} - len({x}))::BIGINT), lambda z: {fill})"
BATCHED = f"b AS (SELECT doc_id, ids[1:{LENGTH}] AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM i), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM b)"


@query("t_batch", f"WITH {IDS}, {BATCHED} SELECT doc_id, batch, {JOINED(f'ids || list_transform(range(0, (longest - len(ids))::BIGINT), lambda z: {PAD})')} AS ids, len(ids) AS attended FROM m")
def t_batch(s, d):
    """Batches of 16 in the order of the ids, padded to the longest of each."""
    rows = _ids(s, d).select("doc_id", F.slice("ids", 1, LENGTH).alias("ids"))
    made = P.batches(rows, "doc_id", "ids", 16, PAD)
    return made.select("doc_id", "batch", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "attended")


PACKED = f"""WITH {IDS}, f AS (SELECT doc_id, ids || [{EOS}] AS d FROM i WHERE len(ids) > 0), t AS (SELECT doc_id, generate_subscripts(d, 1) AS k, unnest(d) AS x FROM f),
 n AS (SELECT x, row_number() OVER (ORDER BY doc_id, k) - 1 AS p FROM t), g AS (SELECT p // {LENGTH - 1} AS seq, list(x ORDER BY p) AS xs FROM n GROUP BY ALL) SELECT seq, {JOINED(f'[{BOS}] || xs')} AS ids FROM g WHERE len(xs) = {LENGTH - 1}"""


@query("t_pack", PACKED)
def t_pack(s, d):
    return _listed(P.pack(_ids(s, d), "doc_id", "ids", LENGTH, BOS, EOS), "seq", "ids")


@query("t_microbatch", f"WITH q AS ({PACKED}) SELECT seq // 8 AS batch, count(*) AS n, min(seq) AS first FROM q GROUP BY ALL HAVING count(*) = 8")
def t_microbatch(s, d):
    packed = P.pack(_ids(s, d), "doc_id", "ids", LENGTH, BOS, EOS)
    return packed.groupBy(F.floor(F.col("seq") / 8).alias("batch")).agg(F.count("*").alias("n"), F.min("seq").alias("first")).where("n = 8")


@query("t_shift_pad", f"WITH {IDS} SELECT doc_id, {JOINED(PADDED('ids[1:len(ids) - 1]', PAD))} AS x, {JOINED(PADDED('ids[2:]', P.IGNORED))} AS y FROM i")
def t_shift_pad(s, d):
    x, y = P.shifted(F.col("ids"), LENGTH, PAD)
    return _listed(_ids(s, d).select("doc_id", x.alias("x"), y.alias("y")), "doc_id", "x", "y")


MARK = f"WITH {IDS}, m AS (SELECT doc_id, list_transform(ids, lambda x: (x % 5)::INT) AS ids FROM i), h AS (SELECT *, coalesce((list_filter(range(1, greatest(len(ids) - 2, 0)::BIGINT + 1), lambda j: ids[j] = 0 AND ids[j + 1] = 0))[1] + 1, 0) AS until FROM m)"


@query("t_label_mask", f"{MARK} SELECT doc_id, {JOINED(f'list_transform(ids, lambda x, k: CASE WHEN k <= until THEN {P.IGNORED} ELSE x END)')} AS labels FROM h")
def t_label_mask(s, d):
    rows = _ids(s, d).select("doc_id", F.transform("ids", lambda x: (x % 5).cast("int")).alias("ids"))
    return _listed(rows.select("doc_id", P.masked_labels(F.col("ids"), [0, 0]).alias("labels")), "doc_id", "labels")


@query("t_collate", f"WITH {IDS} SELECT doc_id, {JOINED(PADDED('ids', PAD))} AS ids, {JOINED(PADDED('list_transform(ids, lambda z: 1)', 0))} AS attention FROM i")
def t_collate(s, d):
    """Every row at the same fixed length, with its attention mask."""
    return _listed(_ids(s, d).select("doc_id", P.padded(F.col("ids"), LENGTH, PAD).alias("ids"), P.attention(F.col("ids"), LENGTH).alias("attention")), "doc_id", "ids", "attention")


@query("t_bpe_train", f"WITH w AS (SELECT unnest({S.words(f'lower({TX})')}) AS w FROM documents), u AS (SELECT w, count(*) AS n FROM w GROUP BY w), p AS (SELECT n, unnest(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) AS pair FROM u WHERE length(w) > 1) SELECT pair, sum(n) AS n FROM p GROUP BY pair HAVING sum(n) >= 2")
def t_bpe_train(s, d):
    """Counts of adjacent character pairs inside words, of those that occur twice or more, the statistics from which the first merges follow; no tokenizer is trained."""
    words = docs(s, d).select(F.explode(T.words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - 1, F.lit(1))), lambda i: F.substr(F.col("w"), i, F.lit(2))))
    return words.where(F.length("w") > 1).select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).where("n >= 2")


# ---------------------------------------------------------------- streams


def _stream(s, d, name: str) -> DataFrame:
    """A table as a stream of files; a single file is given by its folder and name."""
    import os

    path = f"{d}/{name}.parquet"
    schema = table(s, d, name).schema
    reader = s.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("st_iter", "SELECT count(*) AS n, count(text) AS texts FROM documents")
def st_iter(s, d):
    folder = ST.work_folder(s, "iter")
    _stream(s, d, "documents").select("doc_id", F.col("text").isNotNull().alias("has")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.count_if("has").alias("texts"))


@query("st_seen_state", "SELECT sha256(text) AS key FROM documents WHERE text <> '' GROUP BY ALL")
def st_seen_state(s, d):
    folder = ST.work_folder(s, "seen")
    ST.first_seen(_stream(s, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("key")), folder)
    return s.read.parquet(f"{folder}/rows").select("key")


@query("st_cycle", "WITH n AS (SELECT category AS name, count(*) AS rows FROM sft_pool WHERE category IS NOT NULL GROUP BY category) SELECT name, rows, ((row_number() OVER (ORDER BY name) - 1) // 3 + 1)::INT AS cycle FROM n")
def st_cycle(s, d):
    """The categories of the pool in cycles of three: one call does the first cycle, the second goes on from what is processed until none is left."""
    folder = ST.work_folder(s, "cycle")
    rows = table(s, d, "sft_pool").where("category is not null").select(F.col("category").alias("name"), "pair_id")
    names = cut(rows.select("name").distinct())
    work = lambda batch, cycle: rows.join(broadcast_small(batch), "name")
    ST.run_cycles(s, folder, names, work, per_cycle=3, most_cycles=1)
    return ST.run_cycles(s, folder, names, work, per_cycle=3, most_cycles=names.count() // 3 + 1)


@query("st_resume", "SELECT count(*) AS n FROM documents")
def st_resume(s, d):
    """Two runs over one checkpoint: the second finds nothing new."""
    folder = ST.work_folder(s, "resume")
    for _ in range(2):
        _stream(s, d, "documents").select("doc_id").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"))


SQL.update((name, made()) for name, made in LATER.items())
