"""Secrets by fixed patterns and by two character models, in DataFrame functions only.

Tokens of LEAST_CHARS and more are compared under two Markov models of characters, one of random strings and one of
ordinary identifiers: the logarithm of the ratio of their likelihoods is a sum over pairs of neighbouring characters,
read from a table of (SYMBOLS + 1)^2 numbers. A token is a secret if the sum passes ODDS. Both models are counted from
labelled samples; `samples` takes them from a corpus itself.

Places in a text come without a UDF: cut at a pattern, a text is gaps and matches in turn, and running sums of their
lengths are the places. The sums are taken over blocks of BLOCK, so that a text of very many matches costs little more
than one sum for each.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import checkpointed


def _either(word: str) -> str:
    """The pattern of a word in which each letter may have either case, of ASCII alone."""
    return "".join(f"[{c.upper()}{c}]" if c in string.ascii_lowercase else c for c in word)


#: Kind, pattern, and the least code points of what must be long enough.
ASSIGN = f"""({"|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: What the models judge: runs of SYMBOLS this long.
LEAST_CHARS = 16
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}"
#: The least logarithm of the ratio of likelihoods: an ordinary token is taken to be this much likelier than a secret.
ODDS = math.log(10_000)
#: Added to every count of a pair of characters.
PRIOR = 0.5
#: Bounds of the labelled samples: documents that ordinary words are taken from, and strings of a label.
SAMPLE_DOCUMENTS = 1_000
SAMPLE_STRINGS = 5_000
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """For each number of an array the sum of those before it."""

    def simple(block: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
        return F.aggregate(block, start, step, lambda acc: acc["all"])

    def blocked(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK))
        return let(blocks, lambda parts: F.flatten(F.zip_with(parts, simple(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc + x))), lambda part, before: F.transform(simple(part), lambda x: x + before))))

    return let(numbers, lambda n: F.when(F.size(n) <= BLOCK, simple(n)).otherwise(blocked(n)))


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a pattern that matches no empty text: array of (start, end, value), in code points."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(F.length(gap).cast("long").alias("gap"), value.alias("value"), F.coalesce(F.length(value), F.lit(0)).cast("long").alias("size")))

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + x["size"]))
        return F.zip_with(p, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))

    return F.filter(let(parts, placed), lambda x: x["value"].isNotNull())


def _of(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), x["value"].alias("value")))


def base_spans(text: str | Column = "text") -> Column:
    """The spans of the fixed patterns: array of (start, rank of the kind, end, value), in order. Null counts as empty."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_CHARS)
    # Runs that are long enough are found by length at once: a run is matched from its first fitting place to its end.
    access = matches(text, ACCESS.replace("+", f"{{{ACCESS_CHARS - 4},}}"))
    hexes = matches(text, HEX.replace("+", f"{{{HEX_CHARS},}}"))
    return F.array_sort(F.concat(_of("assign", assign), _of("access", access), _of("hex", hexes)))


@dataclass(frozen=True)
class Model:
    """ratios[a * (symbols + 1) + b]: log of P(b | a, random) / P(b | a, ordinary); symbols count from 1, 0 is the start."""

    ratios: tuple[float, ...]

    def score(self, value: Column) -> Column:
        """The logarithm of the ratio of a value's likelihoods; characters outside SYMBOLS count as the start."""
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        width = len(SYMBOLS) + 1
        start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

        def step(acc: Column, c: Column) -> Column:
            return F.struct(c.alias("last"), (acc["sum"] + F.get(table, acc["last"] * width + c)).alias("sum"))

        return F.aggregate(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(SYMBOLS), c)), start, step, lambda acc: acc["sum"])


def _pairs(value: str) -> Column:
    """The numbers a * (symbols + 1) + b of the pairs of neighbouring characters of a value, its start included."""
    width = len(SYMBOLS) + 1
    symbols = F.transform(F.split(F.col(value), ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    return let(symbols, lambda s: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(s, 1, F.size(s) - 1)), s, lambda a, b: a * width + b))


def train(labelled: DataFrame, value: str = "value", label: str = "label") -> Model:
    """The models of label 1 (random strings) and label 0 (ordinary identifiers) of distinct labelled strings.

    Null and empty strings and null labels teach nothing. Without any sample of a label its pairs are all as likely.
    What comes to the driver is one count for each label and pair of characters, whatever the size of the samples.
    """
    width = len(SYMBOLS) + 1
    rows = labelled.where((F.length(value) > 0) & F.col(label).isin(0, 1)).select(F.col(value).alias("value"), F.col(label).cast("int").alias("label")).distinct()
    counts = rows.select("label", F.explode(_pairs("value")).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n")).collect()
    tables = [[PRIOR] * (width * width) for _ in (0, 1)]
    for r in counts:
        tables[r["label"]][r["pair"]] += r["n"]
    logs = [[math.log(n / sum(t[k - k % width : k - k % width + width])) for k, n in enumerate(t)] for t in tables]
    return Model(tuple(round(one - zero, 6) for zero, one in zip(*logs, strict=True)))


def _first(strings: DataFrame) -> DataFrame:
    """At most SAMPLE_STRINGS of the distinct strings, by the order of their hashes."""
    return strings.distinct().orderBy(F.md5("value"), "value").limit(SAMPLE_STRINGS)


def samples(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled strings (value, label) of a corpus, for `train`; spans is docs' base_spans in a column `base`.

    Label 1: what the fixed patterns found, and digests of the keys of the sampled documents written in hexadecimal of either case, base 64
    and its variant for addresses. Label 0: the sampled documents' words and numbers outside these spans and outside what the models
    would judge, alone and joined as identifiers are (a_b, a-b, a/b, aB), and plain numbers from digests of the keys. SAMPLE_DOCUMENTS documents, those of
    the smallest hashes, are sampled, and SAMPLE_STRINGS found strings and pairs of words at most.
    """
    known = spans.select(F.explode("base").alias("s")).select(
        F.when(F.col("s.rank") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value")).alias("value")
    )
    ids = docs.select(F.coalesce(F.col(key).cast("string"), F.md5(text), F.lit("")).alias("id")).distinct().orderBy(F.md5("id"), "id").limit(SAMPLE_DOCUMENTS)
    digest = F.base64(F.unhex(F.sha2(F.concat(F.lit("random "), F.col("id")), 256)))
    random = ids.select(F.explode(F.array(F.sha1("id"), F.upper(F.sha1("id")), digest, F.translate(digest, "+/=", "-_"), F.regexp_replace(digest, "[+/=]", ""))).alias("value"))
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ASSIGN, " "), TOKEN, " ")
    chosen = docs.select(F.coalesce(F.col(key).cast("string"), F.md5(text), F.lit("")).alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    words = chosen.select(F.regexp_extract_all(clean, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    two = F.zip_with("w", F.concat(F.slice("w", 2, F.size("w")), F.slice("w", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    a, b = F.col("p.a"), F.col("p.b")
    pairs = words.select(F.explode(two).alias("p")).distinct().orderBy(F.md5(F.concat_ws(" ", a, b)), a, b).limit(SAMPLE_STRINGS)
    joined = pairs.select(F.explode(F.array(a, F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat_ws("/", a, b), F.concat(a, F.initcap(b)), F.concat(a, b))).alias("value"))
    numbers = ids.select(F.conv(F.substring(F.md5(F.concat(F.lit("number "), F.col("id"))), 1, 15), 16, 10).alias("value"))
    return _first(known).unionByName(random).withColumn("label", F.lit(1)).unionByName(joined.unionByName(numbers).withColumn("label", F.lit(0)))


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with base (the fixed patterns' spans) and tokens (what the models may judge), stored once.

    Columns of docs named base or tokens are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    return checkpointed(docs.withColumns({"base": base_spans(value), "tokens": _of("markov", matches(value, TOKEN))}).drop(text))


def add_spans(spans: DataFrame, model: Model, odds: float = ODDS, out: str = "spans") -> DataFrame:
    """The rows of `found` with all spans in order: the fixed patterns' and the tokens that the models call secrets.

    A token inside a span of the fixed patterns adds nothing. out: array of (start, rank of the kind, end). Null and empty
    texts have no spans; repeated rows and null keys stay as they are; an empty table gives an empty result.
    """
    base = F.col("base")
    secret = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])) & (model.score(t["value"]) >= odds))
    plain = F.transform(F.concat(base, secret), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return spans.withColumn(out, F.array_sort(plain)).drop("tokens")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """docs without the text, with base and spans (see `add_spans`); without a model one is trained on the corpus itself."""
    spans = found(docs, text)
    return add_spans(spans, model or train(samples(docs, spans, key, text)))


def _places_sql(pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """(r, start, rank, end_, value) of the matches of a pattern in docs (r, t): gaps and matches in turn, summed by a window."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, before + gap AS start, {kind} AS rank, before + gap + length(value) AS end_, value FROM (
        SELECT r, value, length(part) AS gap, own, sum(length(part) + coalesce(length(value), 0)) OVER (PARTITION BY r ORDER BY k) - length(part) - coalesce(length(value), 0) AS before
        FROM (SELECT r, unnest(range(len(parts))) AS k, unnest(parts) AS part, unnest(list_concat(found, [NULL])) AS value, unnest(list_concat(owns, [NULL])) AS own
              FROM (SELECT r, string_split_regex(t, '{quoted}') AS parts, regexp_extract_all(t, '{quoted}') AS found, regexp_extract_all(t, '{quoted}', {group}) AS owns FROM docs)))
        WHERE value IS NOT NULL AND length(own) >= {least}"""


def _listed_sql(rows: str) -> str:
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    return f"(SELECT r, string_agg(CASE rank {names} END || ':' || start::BIGINT || ':' || end_::BIGINT, ',' ORDER BY start, rank, end_) AS listed FROM {rows} GROUP BY r)"


def _chosen_sql(key: str = "doc_id", text: str = "text") -> str:
    return f"coalesce({key}::VARCHAR, md5({text}), '')"


_WIDTH = len(SYMBOLS) + 1
#: The query's rows, the models counted from the same samples.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_chosen_sql()} AS id FROM documents),
base AS ({_places_sql(ASSIGN, 0, 2, ASSIGN_CHARS)} UNION ALL {_places_sql(ACCESS, 1, 0, ACCESS_CHARS)} UNION ALL {_places_sql(HEX, 2, 0, HEX_CHARS)}),
tokens AS ({_places_sql(TOKEN, 3)}),
known AS (SELECT DISTINCT CASE WHEN rank = 0 THEN regexp_extract(value, '{ASSIGN.replace("'", "''")}', 2) ELSE value END AS value FROM base),
ids AS (SELECT DISTINCT id, md5(id) AS m FROM docs ORDER BY m, id LIMIT {SAMPLE_DOCUMENTS}),
digests AS (SELECT id, base64(unhex(sha256('random ' || id))) AS d FROM ids),
random AS (SELECT unnest([sha1(id), upper(sha1(id)), d, replace(translate(d, '+/', '-_'), '=', ''), regexp_replace(d, '[+/=]', '', 'g')]) AS value FROM digests),
words AS (SELECT r, regexp_extract_all(regexp_replace(regexp_replace(t, '{ASSIGN.replace("'", "''")}', ' ', 'g'), '{TOKEN}', ' ', 'g'), '[A-Za-z]+|[0-9]+') AS w FROM docs SEMI JOIN ids USING (id)),
pairs AS (SELECT DISTINCT unnest(w) AS a, unnest(list_concat(w[2:], w[1:1])) AS b FROM words WHERE len(w) > 0),
picked AS (SELECT a, b FROM pairs ORDER BY md5(a || ' ' || b), a, b LIMIT {SAMPLE_STRINGS}),
ordinary AS (SELECT unnest([a, a || '_' || b, a || '-' || b, a || '/' || b, a || upper(b[1]) || lower(b[2:]), a || b]) AS value FROM picked
             UNION ALL SELECT ('0x' || substr(md5('number ' || id), 1, 15))::BIGINT::VARCHAR FROM ids),
labelled AS (SELECT DISTINCT value, label FROM (SELECT value, 1 AS label FROM (SELECT value FROM known ORDER BY md5(value), value LIMIT {SAMPLE_STRINGS}) UNION ALL SELECT value, 1 FROM random UNION ALL SELECT value, 0 FROM ordinary) WHERE length(value) > 0),
symbols AS (SELECT label, list_transform(string_split(value, ''), lambda c: instr('{SYMBOLS}', c)) AS s FROM labelled),
counted AS (SELECT label, a, b, count(*) AS n FROM (SELECT label, unnest(list_concat([0], s[:-2])) AS a, unnest(s) AS b FROM symbols) GROUP BY ALL),
cells AS (SELECT y.label, x.a, z.b, coalesce(n, 0) + {PRIOR} AS n FROM (SELECT unnest([0, 1]) AS label) y, (SELECT unnest(range({_WIDTH})) AS a) x, (SELECT unnest(range({_WIDTH})) AS b) z LEFT JOIN counted c ON c.label = y.label AND c.a = x.a AND c.b = z.b),
logs AS (SELECT label, a, b, ln(n::DOUBLE / sum(n::DOUBLE) OVER (PARTITION BY label, a)) AS l FROM cells),
ratios AS (SELECT a, b, round(sum(CASE WHEN label = 1 THEN l ELSE -l END), 6) AS x FROM logs GROUP BY a, b),
scored AS (SELECT v.value, sum(x) AS score FROM (SELECT value, unnest(list_concat([0], s[:-2])) AS a, unnest(s) AS b FROM (SELECT value, list_transform(string_split(value, ''), lambda c: instr('{SYMBOLS}', c)) AS s FROM (SELECT DISTINCT value FROM tokens))) v JOIN ratios USING (a, b) GROUP BY v.value),
more AS (SELECT t.r, t.start, t.rank, t.end_ FROM tokens t JOIN scored s ON s.value = t.value AND s.score >= {ODDS!r} WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.start <= t.start AND t.end_ <= b.end_)),
every AS (SELECT r, start, rank, end_ FROM base UNION ALL SELECT * FROM more),
sums AS (SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h FROM base GROUP BY r)
SELECT d.doc_id, coalesce(s.a, 0)::BIGINT AS n_assign, coalesce(s.c, 0)::BIGINT AS n_access, coalesce(s.h, 0)::BIGINT AS n_hex, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(e.listed, '') AS spans
FROM docs d LEFT JOIN sums s USING (r) LEFT JOIN {_listed_sql("base")} b USING (r) LEFT JOIN {_listed_sql("every")} e USING (r)
"""
