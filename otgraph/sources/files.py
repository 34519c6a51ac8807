"""File sources: tag-tree exports, Turtle model files and the template catalogue."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from otgraph.functions.iri import RDF_TYPE
from otgraph.schemas import MODEL_TRIPLES, TAG_LEAF
from otgraph.session import materialize


# ------------------------------------------------------------------ tag trees -----------------

def load_tag_tree(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Flatten nested tag-folder exports to their leaf AtomicTags.

    ``sources`` maps provider → file (or glob); each file is one JSON document. Folders are
    expanded level by level with ``explode`` of the VARIANT ``tags`` array until no folder is
    left; the folders of a level are checkpointed once, so no level restarts from the text. Path: ``[provider]Root/…/Name``.
    """
    roots = None
    for provider, path in sources.items():
        df = spark.read.text(path, wholetext=True).select(
            F.lit(provider).alias("provider"), F.parse_json("value").alias("node"))
        roots = df if roots is None else roots.unionByName(df)
    if roots is None:
        return spark.createDataFrame([], TAG_LEAF)
    name = F.try_variant_get(F.col("node"), "$.name", "string")
    level = roots.select("provider", name.alias("path"), "node")
    leaves = []
    level = materialize(level)
    while not level.isEmpty():
        kind = F.try_variant_get(F.col("node"), "$.tagType", "string")
        leaves.append(level.filter(kind == "AtomicTag"))
        kids = level.filter(kind == "Folder").select(
            "provider", "path",
            F.explode(F.try_variant_get(F.col("node"), "$.tags", "array<variant>")).alias("node"))
        level = materialize(kids.select("provider", F.concat_ws("/", "path", name).alias("path"), "node"))
    if not leaves:
        return spark.createDataFrame([], TAG_LEAF)
    out = leaves[0]
    for lf in leaves[1:]:
        out = out.unionByName(lf)

    def g(field):
        return F.try_variant_get(F.col("node"), f"$.{field}", "string")

    return out.select(
        F.concat(F.lit("["), F.col("provider"), F.lit("]"), F.col("path")).alias("tag_path"),
        "provider", g("name").alias("name"), g("dataType").alias("data_type"),
        g("valueSource").alias("value_source"),
        F.to_json(F.try_variant_get(F.col("node"), "$.value", "variant")).alias("value"))


# ------------------------------------------------------------------ Turtle subset --------------

_TOKEN = re.compile(r'''
    (?P<ws>\s+) | (?P<comment>\#[^\n]*) |
    (?P<iri><[^>]*>) |
    (?P<lit>"""(?:.|\n)*?"""|"(?:[^"\\\n]|\\.)*") (?:\^\^(?P<dtype><[^>]*>|[A-Za-z_][\w\-]*:[\w\-]*)|@(?P<lang>[A-Za-z\-]+))? |
    (?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?) |
    (?P<punct>[.;,]) |
    (?P<pname>[A-Za-z_][\w\-]*:[\w\-.]*[\w\-]|[A-Za-z_][\w\-]*:|:[\w\-]+|@prefix|@base|a\b|true|false)
''', re.VERBOSE)

# Xsd namespace and the datatype of bare numbers and booleans.
_XSD = "http://www.w3.org/2001/XMLSchema#"


_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
# Turtle's one-letter escapes.
_ESCAPED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPED.get(m[3], m[3]), s)


def parse_turtle(text: str, graph: str, prefixes: dict[str, str] | None = None) -> list[tuple[str, str, str, str, str]]:
    """The Turtle subset the model files use: @prefix, ``a``, ``;`` and ``,`` lists, IRIs,
    prefixed names, plain / typed / language literals, numbers, booleans, comments. ``prefixes``: those in force
    where the text begins; the text's own are added to them."""
    prefixes = {} if prefixes is None else prefixes
    toks = []
    pos = 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"unsupported Turtle at offset {pos}: {text[pos:pos + 30]!r}")
        pos = m.end()
        if m.lastgroup in ("ws", "comment"):
            continue
        toks.append(m)

    def term(m) -> tuple[str, str]:
        k = m.lastgroup if m.lastgroup != "dtype" and m.lastgroup != "lang" else "lit"
        if m.group("lit") is not None:
            raw = m.group("lit")
            body = raw[3:-3] if raw.startswith('"""') else raw[1:-1]
            dt = m.group("dtype")
            return _unescape(body), (expand(dt) if dt else ("literal" if not m.group("lang")
                                                             else "literal@" + m.group("lang")))
        if k == "iri":
            return m.group("iri")[1:-1], "iri"
        if k == "num":
            v = m.group("num")
            return v, _XSD + ("integer" if re.fullmatch(r"[+-]?\d+", v) else "decimal")
        v = m.group("pname")
        if v in ("true", "false"):
            return v, _XSD + "boolean"
        if v == "a":
            return RDF_TYPE, "iri"
        return expand(v), "iri"

    def expand(v: str) -> str:
        if v.startswith("<"):
            return v[1:-1]
        pre, _, local = v.partition(":")
        return prefixes.get(pre, pre + ":") + local

    out = []
    i = 0
    while i < len(toks):
        t = toks[i]
        if t.lastgroup == "pname" and t.group("pname") in ("@prefix", "@base"):
            if t.group("pname") == "@prefix":
                prefixes[toks[i + 1].group("pname").rstrip(":")] = toks[i + 2].group("iri")[1:-1]
                i += 4
            else:
                i += 3
            continue
        subj, _ = term(t)
        i += 1
        while i < len(toks):
            pred, _ = term(toks[i])
            i += 1
            while True:
                obj, otype = term(toks[i])
                out.append((graph, subj, pred, obj, otype))
                i += 1
                if toks[i].group("punct") == ",":
                    i += 1
                    continue
                break
            punct = toks[i].group("punct")
            i += 1
            if punct == ";":
                if toks[i].group("punct") == ".":
                    i += 1
                    break
                continue
            break
    return out


#: Characters of a file that one row holds and one parse reads; a longer line is a row of its own.
CHUNK_CHARS = 1 << 18
#: Triples that a worker holds before it hands them on.
ROWS_OUT = 10_000


def _scan(text: str, inside: bool) -> tuple[bool, int, int]:
    """From a line start, in a long literal or not: whether its end is in one, and the places after the first and the last
    end of a statement (-1: none). Nothing else of the Turtle subset goes on over a line end."""
    pos, first, last = 0, -1, -1
    if inside:
        pos = text.find('"""') + 3
        if pos < 3:
            return True, -1, -1
    while pos < len(text):
        if text.startswith('"""', pos) and text.find('"""', pos + 3) < 0:
            return True, first, last
        m = _TOKEN.match(text, pos)
        if m is None:
            pos += 1                                    # no Turtle here: the state that was assumed does not hold
            continue
        pos = m.end()
        if m.lastgroup == "punct" and m.group("punct") == ".":
            first, last = (pos if first < 0 else first), pos
    return False, first, last


def _chunks(spark: SparkSession, paths: str, chunk_chars: int) -> DataFrame:
    """(graph, pos, text, from_out, from_in): runs of lines of a file, as Spark splits it, and whether they end in a long literal
    if they begin outside or inside of one. ``pos`` orders a file's chunks."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.input_file_name().alias("graph"), F.col("_metadata.file_block_start").alias("start"), F.col("value"))

    def run(batches):
        held, size, where, seq = [], 0, None, 0

        def row():
            text = "\n".join(held) + "\n"
            plain = '"""' not in text                   # neither opens nor closes one
            return {"graph": [where[0]], "start": [where[1]], "seq": [seq], "text": [text],
                    "from_out": [False if plain else _scan(text, False)[0]], "from_in": [True if plain else _scan(text, True)[0]]}

        for pdf in batches:
            for g, s, v in zip(pdf["graph"], pdf["start"], pdf["value"]):
                if where != (g, s) or size >= chunk_chars:
                    if held:
                        yield pd.DataFrame(row())
                    seq = seq + 1 if where == (g, s) else 0
                    held, size, where = [], 0, (g, s)
                held.append(v)
                size += len(v) + 1
        if held:
            yield pd.DataFrame(row())

    out = lines.mapInPandas(run, "graph string, start long, seq int, text string, from_out boolean, from_in boolean")
    return materialize(out.select("graph", F.struct("start", "seq").alias("pos"), "text", "from_out", "from_in"))


def _statements(chunks: DataFrame) -> DataFrame:
    """(graph, pos, place, text): whole statements in file order of (pos, place): the inside of each chunk, and the statements
    that go on over chunk ends, put together from their parts."""
    before = Window.partitionBy("graph").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # what a chunk does to the state: sets it, turns it over or leaves it
    sets = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    turns = F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)
    marks = chunks.select("graph", "pos", sets.alias("sets"), turns.alias("turns"))
    upto = marks.withColumn("_t", F.sum("turns").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.last(F.when(F.col("sets").isNotNull(), F.struct(F.col("sets").alias("v"), F.col("_t").alias("t"))), ignorenulls=True).over(before)
    state = (upto.withColumn("_l", last).withColumn("_n", F.coalesce(F.last("_t").over(before), F.lit(0)) - F.coalesce(F.col("_l.t"), F.lit(0)))
             .select("graph", "pos", (F.coalesce(F.col("_l.v"), F.lit(False)) != (F.col("_n") % 2 == 1)).alias("inside")))

    def cut(batches):
        for pdf in batches:
            for g, p, text, inside in zip(pdf["graph"], pdf["pos"], pdf["text"], pdf["inside"]):
                _, a, b = _scan(text, inside)
                row = (g, p, a >= 0, text[:a] if a >= 0 else text, text[a:b] if a >= 0 else "", text[b:] if a >= 0 else "")
                yield pd.DataFrame([row], columns=["graph", "pos", "ends", "head", "body", "tail"])

    pos = "struct<start:bigint,seq:int>"
    parts = materialize(chunks.join(state, ["graph", "pos"]).select("graph", "pos", "text", "inside").mapInPandas(
        cut, f"graph string, pos {pos}, ends boolean, head string, body string, tail string"))
    opened = parts.select("graph", "pos", "head", F.max(F.when(F.col("ends"), F.col("pos"))).over(before).alias("of"))
    pieces = (parts.where("ends").select("graph", F.col("pos").alias("of"), "pos", F.lit(0).alias("k"), F.col("tail").alias("text"))
              .unionByName(opened.select("graph", "of", "pos", F.lit(1).alias("k"), F.col("head").alias("text"))))
    joined = pieces.groupBy("graph", "of").agg(F.sort_array(F.collect_list(F.struct("pos", "k", "text"))).alias("x")).select(
        "graph", F.col("of").alias("pos"), F.lit(1).alias("place"), F.array_join("x.text", "").alias("text"))
    return parts.where("ends").select("graph", "pos", F.lit(0).alias("place"), F.col("body").alias("text")).unionByName(joined)


def _parsed(batches):
    """Triples of (graph, text, known prefixes), handed on in frames of ``ROWS_OUT``."""
    names, rows = ["graph", "s", "p", "o", "o_type"], []
    for pdf in batches:
        for g, text, known in zip(pdf["graph"], pdf["text"], pdf["known"]):
            rows += parse_turtle(text, g, {x["name"]: x["iri"] for x in known} if known is not None else {})
            while len(rows) >= ROWS_OUT:
                yield pd.DataFrame(rows[:ROWS_OUT], columns=names)
                del rows[:ROWS_OUT]
    yield pd.DataFrame(rows, columns=names)


def load_turtle(spark: SparkSession, paths: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Turtle files → (graph, s, p, o, o_type) (S10); ``graph`` is the file path.

    Files are read in the ranges that Spark splits them into. Every chunk of lines tells what it does to the one state that
    outlasts a line end (inside a long literal or not), a window per file over these marks gives each chunk's own
    state, and then the ends of its statements. Statements over chunk ends are put together from their parts. The
    prefixes are read first, from the statements that declare any; a statement sees those before it in its file."""
    statements = materialize(_statements(_chunks(spark, paths, chunk_chars)).where(F.col("text").rlike(r"\S")))
    at = F.struct("pos", "place")

    def declared(batches):
        for pdf in batches:
            rows = []
            for g, p, k, text in zip(pdf["graph"], pdf["pos"], pdf["place"], pdf["text"]):
                own: dict[str, str] = {}
                parse_turtle(text, g, own)
                rows += [(g, p, k, a, b) for a, b in own.items()]
            yield pd.DataFrame(rows, columns=["graph", "pos", "place", "name", "iri"])

    pos = "struct<start:bigint,seq:int>"
    names = statements.where(F.col("text").contains("@prefix")).mapInPandas(declared, f"graph string, pos {pos}, place int, name string, iri string")
    per_file = names.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "name", "iri"))).alias("names"))

    known = statements.join(per_file, "graph", "left").select("graph", "text", F.filter("names", lambda x: x["at"] < at).alias("known"))
    return known.mapInPandas(_parsed, schema=MODEL_TRIPLES)


# ------------------------------------------------------------------ template catalogue --------

def template_fields(file_name, content) -> dict[str, F.Column]:
    """Name, description and category of a template file."""
    fn = F.regexp_extract(file_name, r"([^/]*)$", 1)
    words = F.lower(F.replace(F.replace(fn, F.lit(".ttl"), F.lit("")), F.lit("_"), F.lit(" ")))
    # title case: every run of letters starts with a capital
    runs = F.regexp_extract_all(words, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    name = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")
    lines = F.filter(F.split(content, "\n"),
                     lambda x: F.trim(x).startswith("# ") & ~F.lower(x).contains("prefix"))
    desc = F.coalesce(F.substring(F.trim(F.try_element_at(lines, F.lit(1))), 3, 1 << 20),
                      F.lit("Local TTL file template"))
    low = F.lower(fn)
    # Category words, id prefix and default description.
    cat = (F.when(low.contains("oil") | low.contains("rig"), "oil-gas")
           .when(low.contains("factory"), "manufacturing").otherwise("template"))
    return {"id": F.concat(F.lit("local_"), fn), "name": name, "description": desc,
            "category": cat, "filename": fn}


def ttl_template_catalog(spark: SparkSession, directory: str) -> DataFrame:
    """One row per ``*.ttl`` file: id, title-cased name, first '# ' comment without 'prefix'
    as description, category by file name, content (S11)."""
    files = spark.read.text(f"{directory.rstrip('/')}/*.ttl", wholetext=True) \
        .select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))
    f = template_fields(F.col("path"), F.col("content"))
    return files.select(f["id"].alias("id"), f["name"].alias("name"),
                        f["description"].alias("description"), f["category"].alias("category"),
                        F.lit(True).alias("is_template"), "content",
                        f["filename"].alias("filename"))
