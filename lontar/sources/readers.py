"""Readers of the input shapes: Parquet folders, JSON lines and arrays, literals, files, chats, pages, unknown tables."""

from __future__ import annotations

import ast
import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lontar.functions import text as T
from lontar.functions.rules import lexicon_hits, stopword_share


def parquet_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern or folder, with the file in ``file`` (files are ordered by it)."""
    return spark.read.parquet(pattern).withColumn("file", F.col("_metadata.file_path"))


def safe_load(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The table, or None where it cannot be read."""
    try:
        return spark.read.format(kind).load(path)
    except Exception:  # the reference behaviour is to go on without it
        return None


def instruction_rows(rows: DataFrame, source: str, category: str = "general") -> DataFrame:
    """``instruction``, ``response``, ``category``, ``source``: ``output``, or ``response`` where that is empty; rows with an empty side are dropped."""
    has = set(rows.columns)
    text = lambda c: T.text_or_empty(F.col(c)) if c in has else F.lit("")
    response = F.coalesce(F.nullif(text("output"), F.lit("")), text("response"))
    kind = F.coalesce(F.nullif(text("category"), F.lit("")), F.lit(category))
    made = rows.select(*[F.col("pair_id")] * ("pair_id" in has), text("instruction").alias("instruction"), response.alias("response"), kind.alias("category"), F.lit(source).alias("source"))
    return made.where("instruction <> '' and response <> ''")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; malformed lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def question_array(spark: SparkSession, path: str, category: str, source: str) -> DataFrame:
    """A file with one JSON array of ``{q, a}``."""
    rows = spark.read.schema("q string, a string").json(path, multiLine=True)
    return rows.select(F.col("q").alias("instruction"), F.col("a").alias("response"), F.lit(category).alias("category"), F.lit(source).alias("source")).where("instruction <> '' and response <> ''")


def python_literal(spark: SparkSession, path: str, name: str = "DATASET") -> DataFrame:
    """Rows of the list assigned to ``name`` in Python files, which are parsed, never run, each by the worker that reads it.

    Values become text, missing ones null; the columns are ``instruction`` and ``response``.  A file without such a list gives no row.
    """

    @F.arrow_udf(ArrayType(StructType([StructField("instruction", StringType()), StructField("response", StringType())])))
    def rows(text: pa.Array) -> pa.Array:
        as_text = lambda v: None if v is None else str(v)
        made = [[{"instruction": as_text(r.get("instruction")), "response": as_text(r.get("response"))} for r in literal_rows(t, name)] for t in text.to_pylist()]
        return pa.array(made, pa.list_(pa.struct([("instruction", pa.string()), ("response", pa.string())])))

    return spark.read.text(path, wholetext=True).select(F.explode(rows("value")).alias("r")).select("r.*")


def literal_rows(text: str, name: str) -> list[dict]:
    """The dictionaries of the list that is assigned to ``name``."""
    for node in ast.parse(text).body:
        targets = node.targets if isinstance(node, ast.Assign) else []
        if any(isinstance(t, ast.Name) and t.id == name for t in targets):
            return [r for r in ast.literal_eval(node.value) if isinstance(r, dict)]
    return []


def matched_files(spark: SparkSession, pattern: str) -> int:
    """How many files a pattern matches, on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def seed_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*.md", "*.py")) -> DataFrame:
    """Whole files as documents: ``text``, ``source`` (the path)."""
    out = None
    for pattern in patterns:
        rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


def seed_documents(texts: DataFrame, pairs: DataFrame, least: int = 120) -> DataFrame:
    """Texts and instruction pairs as documents of at least ``least`` normalised characters."""
    both = texts.select("text", "source").unionByName(pairs.select(F.concat("instruction", F.lit("\n\n"), "response").alias("text"), "source"))
    return both.withColumn("text", T.normalize(F.col("text"))).where(F.length("text") >= least)


def tokenizer_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ``.txt`` and ``.text`` files, ``text`` else ``content`` of ``.jsonl`` ones (bad JSON is skipped); other files are ignored."""
    read = spark.read.option("recursiveFileLookup", True)
    plain = read.option("pathGlobFilter", "*.{txt,text}").text(folder).select(F.col("value").alias("text"))
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").schema("text string, content string").json(folder, mode="DROPMALFORMED")
    return plain.unionByName(rows.select(F.coalesce(F.nullif("text", F.lit("")), "content").alias("text"))).where("text <> ''")


class _Paragraphs(HTMLParser):
    """Text inside ``p`` elements; a paragraph ends at its end tag or at the next beginning."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.inside = True
            self.found.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "div", "body", "html", "article", "section"):
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def paragraphs_of(html: str | None) -> str:
    if not html:
        return ""
    parser = _Paragraphs()
    parser.feed(html)
    parser.close()
    return "\n".join(p.strip() for p in parser.found if p.strip())


@F.arrow_udf(StringType())
def paragraphs(html: pa.Array) -> pa.Array:
    """The text of a page's paragraphs, joined by line feeds; null and broken pages give what can be read."""
    return pa.array([paragraphs_of(h) for h in html.to_pylist()], pa.string())


def scraped(pages: DataFrame, least: int = 300, least_stopwords: float = 0.05) -> DataFrame:
    """``page_id``, ``text`` of the pages whose cleaned text is longer than ``least`` and Indonesian by its stop-words."""
    rows = pages.select("page_id", T.clean(paragraphs(F.col("html"))).alias("text"))
    return rows.where((F.length("text") > least) & (stopword_share(F.col("text")) > F.lit(least_stopwords)))


# Parts of column names that mark their role, most telling first.
INSTRUCTION_NAMES = ("instruction", "question", "input", "prompt", "query", "premise", "source", "text")
OUTPUT_NAMES = ("output", "answer", "response", "target", "summary", "completion", "hypothesis")
CONVERSATION_NAMES = ("conversation", "messages")
TEXT_NAMES = ("text", "content", "article", "body")


def _named(columns: list[str], parts: tuple[str, ...]) -> str | None:
    return next((c for c in columns for p in parts if p in c.lower()), None)


def inferred_pairs(rows: DataFrame) -> DataFrame | None:
    """``instruction`` and ``output`` of a table of unknown columns, by the parts of their names.

    A pair of columns first, then a conversation column (its first two turns), then a
    text column (Indonesian texts above 200 characters become tasks to sum them up);
    None where no column fits.
    """
    instruction, output = _named(rows.columns, INSTRUCTION_NAMES), _named(rows.columns, OUTPUT_NAMES)
    if instruction and output:
        as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        return rows.select(F.substring(as_text(instruction), 1, 500).alias("instruction"), F.substring(as_text(output), 1, 1500).alias("output"))
    talk = _named(rows.columns, CONVERSATION_NAMES)
    if talk:
        fields = {f.name for f in rows.schema[talk].dataType.elementType.fields}
        key = "value" if "value" in fields else "content"
        turn = lambda i, n: F.substring(F.coalesce(F.get(F.col(talk), F.lit(i))[key], F.lit("")), 1, n)
        return rows.where(F.size(talk) >= 2).select(turn(0, 500).alias("instruction"), turn(1, 1500).alias("output"))
    text = _named(rows.columns, TEXT_NAMES)
    if text:
        from lontar.functions.rules import COMMON_WORDS

        t = T.text_or_empty(F.col(text))
        first, second = T.summary_pair(t)
        return rows.where((F.length(t) > 200) & (lexicon_hits(t, COMMON_WORDS) >= 2)).select(first.alias("instruction"), second.alias("output"))
    return None


def parse_payload(raw: str | None) -> list[dict]:
    """Pairs in the answer of a generating model: fenced or bare JSON, an object with a list inside, or a list."""
    text = (raw or "").strip()
    if text.count("```") >= 2:
        inner = text.split("```")[1]
        text = inner[4:].strip() if inner[:4].lower() == "json" else inner.strip()
    tries = [text]
    for left, right in ("{}", "[]"):
        a, b = text.find(left), text.rfind(right)
        if 0 <= a < b:
            tries.append(text[a : b + 1])
    for attempt in tries:
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        if isinstance(value, dict):
            inner = next((value[k] for k in ("items", "data", "pairs") if isinstance(value.get(k), (list, dict))), None)
            if inner is not None:
                return inner if isinstance(inner, list) else [inner]
        elif isinstance(value, list):
            single = lambda d: len(d) == 1 and isinstance(next(iter(d.values())), dict)
            return [next(iter(d.values())) if single(d) else d for d in value if isinstance(d, dict)]
    return []


@F.arrow_udf(ArrayType(StructType([StructField("instruction", StringType()), StructField("response", StringType())])))
def payload_pairs(raw: pa.Array) -> pa.Array:
    rows = [[{"instruction": str(p.get("instruction") or ""), "response": str(p.get("response") or p.get("output") or "")} for p in parse_payload(r) if isinstance(p, dict)] for r in raw.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("instruction", pa.string()), ("response", pa.string())])))


def stopword_scores(text: Column, lexicons: dict[str, list[str]]) -> Column:
    """``language`` with the most words of its lexicon among the first 2,000 characters (of equal ones the first), its share of all hits as ``probability``; null without any.

    The probe of 2,000 characters is that of the reference behaviour.
    The words are counted in one pass over Arrow batches: as Column expressions they are
    interpreted word by word, for each lexicon and each use of its count again.
    """
    codes, of = sorted(lexicons), {}
    for i, code in enumerate(codes):
        for w in set(lexicons[code]):
            of.setdefault(w, []).append(i)

    @F.arrow_udf(StructType([StructField("language", StringType()), StructField("probability", DoubleType())]))
    def scores(probe: pa.Array) -> pa.Array:
        out = []
        for t in probe.to_pylist():
            hits = [0] * len(codes)
            for w in filter(of.__contains__, t[:2000].lower().split() if t else ()):
                for i in of[w]:
                    hits[i] += 1
            most = max(hits, default=0)
            out.append({"language": codes[hits.index(most)], "probability": most / sum(hits)} if most else None)
        return pa.array(out, pa.struct([("language", pa.string()), ("probability", pa.float64())]))

    return scores(text)


def stopword_language(text: Column, lexicons: dict[str, list[str]]) -> Column:
    """The language of ``stopword_scores``."""
    return stopword_scores(text, lexicons)["language"]
