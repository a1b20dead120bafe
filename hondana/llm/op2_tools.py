"""Tool-call linking for chat data. DataFrame functions only.

Calls and results meet by conversation and identifier in a hash join; where an identifier is repeated, the first call meets the first result,
the second the second and so on, so all are kept and no pairs are made. Calls
are ordered so that each follows the calls whose results its arguments use. Calls with one need form chains, which doubling steps
take back to their first call in as many joins as the length has binary digits; levels of calls with several needs then grow outward, one join a level, over
the edges not yet settled. Arguments are checked against the tool's schema, a tree of objects (required keys, closed or open), arrays, enumerations,
numbers with bounds and plain types, compiled to one expression. Everything is serialised as canonical JSON: keys sorted, no white
space, one form for every value (Spark's variant keeps object keys sorted). Numbers never pass through a binary type: their literals are
brought to one form as text, so ``1e2`` and ``100.0`` are ``100`` and no digit of any number is lost.

Edge cases, each named in ``errors``: duplicate identifiers (numbered by turn, then name and arguments; they share a level, above the needs of
all), calls without a result, results without a call (rows of their own, no name), malformed arguments, unknown tools, missing or unknown keys, wrong
types, needs that are unknown or in a cycle (level null, last in order). Rows without an identifier are left out, or with ``unnamed`` come as rows of their own. Null contents are
JSON null. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hondana.llm import scratch

#: Places per range when positions are counted within a conversation.
RANGE = 1024

#: A tree: "string", "integer", "number", "boolean", "null", "any", or one of the classes below.
Schema = "str | Object | Array | Enum | Number"
#: tool -> {argument: (schema, required)}; or tool -> Object.
Schemas = "dict[str, dict[str, tuple[Schema, bool]] | Object]"


@dataclass(frozen=True)
class Object:
    """``keys``: name -> (schema, required). A closed object has no others."""

    keys: dict
    closed: bool = True


@dataclass(frozen=True)
class Array:
    of: object = "any"


@dataclass(frozen=True)
class Enum:
    """One of some values (anything that JSON can hold)."""

    values: tuple


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None
    integer: bool = False


#: Names that Spark gives the types of values.
_SAME = {"BIGINT": "integer", "DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean"}
#: Stands before a number's text while it travels as a string, as JSON and as the character itself.
_MARK, _MARKED = "\\u0001", "\x01"
#: Strings, numbers and what is between them.
_TOKENS = '(?s)"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"|-?[0-9]++(?:\\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|[^"0-9-]++|.'
_NUMBER = "^-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
#: Zeros that a number may end or begin with before its form has an exponent.
_ZEROS = 20


def _plain(number: Column) -> Column:
    """The one form of a number's literal: digits without idle zeros, and an exponent only beyond ``_ZEROS`` zeros; as it stands if its exponent has more than 18 digits."""
    sign = F.regexp_extract(number, "^-?", 0)
    whole, part, power = (F.regexp_extract(number, "^-?([0-9]+)(?:\\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", k) for k in (1, 2, 3))
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    exponent = F.when(power == "", F.lit(0).cast("long")).otherwise(F.when(F.length(F.regexp_replace(power, "^[+-]?0*", "")) <= 18, power.try_cast("long"))) - F.length(part) + F.length(digits) - F.length(short)

    def form(x: Column) -> Column:
        d, e = x["d"], x["e"]
        size = F.length(d)
        text = (
            F.when((e >= 0) & (e <= _ZEROS), F.concat(d, F.repeat(F.lit("0"), F.greatest(e, F.lit(0)).cast("int"))))
            .when((e < 0) & (-e < size), F.concat(F.substr(d, F.lit(1), (size + e).cast("int")), F.lit("."), F.substr(d, (size + e + 1).cast("int"))))
            .when((e < 0) & (-e - size <= _ZEROS), F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - size, F.lit(0)).cast("int")), d))
            .otherwise(F.concat(d, F.lit("E"), e.cast("string")))
        )
        return F.when(d == "", F.lit("0")).when(e.isNull(), number).otherwise(F.concat(sign, text))

    return F.transform(F.array(F.struct(short.alias("d"), exponent.alias("e"))), form)[0]


def _marked(text: Column) -> Column:
    """JSON text as a variant whose numbers are strings, marked, in their one form; null where it isn't JSON."""

    def token(x: Column) -> Column:
        number = F.concat(F.lit(f'"{_MARK}'), _plain(x), F.lit('"'))
        # A string that begins with the mark gets a second one; a number that isn't one as JSON has it stays, and fails.
        return F.when(x.rlike(_NUMBER), number).when(x.startswith(f'"{_MARK}') | x.startswith(f'"{_MARKED}'), F.concat(F.lit(f'"{_MARK}'), F.substr(x, F.lit(2)))).otherwise(x)

    return F.try_parse_json(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), token), ""))


def _written(value: Column) -> Column:
    """A variant of :func:`_marked` as canonical JSON."""
    numbers = F.regexp_replace(F.to_json(value), '"\\\\u0001(-?[0-9][0-9.eE+-]*)"', "$1")
    return F.regexp_replace(numbers, '"\\\\u0001\\\\u0001', '"\\\\u0001')


def _python_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def _errors(value: Column, schema: object, path: str) -> Column:
    """array<string>: what is wrong with a variant (never null) of :func:`_marked`, each told with its path."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    # A marked number; a string that itself begins with the mark has two.
    is_number = F.coalesce((kind == "STRING") & text.rlike(f"^{_MARKED}-?[0-9]"), F.lit(False))
    wrong = F.array(F.lit(f"type of {path}"))
    none = F.array().cast("array<string>")

    def only(test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), none).otherwise(wrong)

    is_whole = is_number & ~F.contains(text, F.lit(".")) & ~text.rlike("E-")
    if isinstance(schema, str):
        name = _SAME.get(schema, schema)
        tests = {"any": F.lit(True), "string": (kind == "STRING") & ~is_number, "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": is_number, "integer": is_whole}
        return only(tests[name])
    if isinstance(schema, Number):
        size = F.substr(text, F.lit(2)).try_cast("double")
        inside = (F.lit(True) if schema.least is None else size >= schema.least) & (F.lit(True) if schema.most is None else size <= schema.most)
        return F.when(is_whole if schema.integer else is_number, F.when(inside, none).otherwise(F.array(F.lit(f"range of {path}")))).otherwise(wrong)
    if isinstance(schema, Enum):
        return F.when(_written(value).isin([_written(_marked(F.lit(_python_json(x)))) for x in schema.values]), none).otherwise(F.array(F.lit(f"value of {path}")))
    if isinstance(schema, Array):
        each = F.transform(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: _errors(_some(x), schema.of, f"{path}[]"))
        return F.when(kind.startswith("ARRAY"), F.array_distinct(F.flatten(each))).otherwise(wrong)
    return F.when(kind.startswith("OBJECT"), _of_keys(value, schema, f"{path}.")).otherwise(wrong)


def _some(value: Column) -> Column:
    """JSON's null, where Spark makes a null of it."""
    return F.coalesce(value, F.parse_json(F.lit("null")))


def _of_keys(value: Column, schema: Object, before: str) -> Column:
    by_key = F.try_variant_get(value, "$", "map<string,variant>")  # no path, so keys may hold any character
    names, found = F.map_keys(by_key), []
    for key, (kind, required) in sorted(schema.keys.items()):
        own = _errors(_some(F.try_element_at(by_key, F.lit(key))), kind, f"{before}{key}")
        there = F.array_contains(names, key)
        found.append(F.when(there, own).otherwise(F.array(F.lit(f"missing {before}{key}")) if required else F.array().cast("array<string>")))
    if schema.closed:
        unknown = F.array_sort(F.array_except(names, F.array(*map(F.lit, sorted(schema.keys)))) if schema.keys else names)
        found.append(F.transform(unknown, lambda k: F.concat(F.lit(f"unknown {before}"), k)))
    return F.concat(*found) if found else F.array().cast("array<string>")


def errors_of(schemas: Schemas) -> Column:
    """Errors in column ``arguments`` (JSON text) of a call of tool ``name``."""
    parsed = _marked(F.col("arguments"))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))

    def judged(x: Column) -> Column:
        out = F.array(F.lit("unknown tool"))
        for tool, keys in schemas.items():
            errors = _of_keys(x["v"], keys if isinstance(keys, Object) else Object(keys), "")
            out = F.when(F.col("name") == tool, F.when(x["object"], errors).otherwise(F.array(F.lit("malformed arguments")))).otherwise(out)
        return out

    return F.transform(F.array(F.struct(parsed.alias("v"), is_object.alias("object"))), judged)[0]


def canonical(text: Column) -> Column:
    """JSON text with sorted keys, no white space and one form for every value; null where it isn't JSON."""
    return _written(_marked(text))


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level of every identifier in ``calls`` (call_id, needs array<string>; repeats add their needs) that no cycle or unknown need holds back."""
    spark, path = calls.sparkSession, scratch.folder(calls.sparkSession, "levels")

    def keep(rows: DataFrame, number: int) -> DataFrame:
        """Each round's rows are written once, to a folder that in the end holds those of all."""
        rows.write.parquet(f"{path}/round={number}")
        return spark.read.schema(rows.schema).parquet(f"{path}/round={number}")

    edges = scratch.write(calls.select("call_id", F.explode(F.array_distinct("needs")).alias("need")).where("need is not null").distinct(), "edges")
    needs = edges.groupBy("call_id").count()
    new, number = keep(calls.select("call_id").distinct().join(needs, "call_id", "left_anti").withColumn("level", F.lit(0)), 0), 0
    one = edges.join(needs.where("count = 1"), "call_id").select("call_id", F.col("need").alias("back"), F.lit(1).alias("steps"))
    chains = _chains(scratch.write(one, "chains"))
    # Edges of calls with several needs, each from the end of the chain that the need is on.
    end = chains.select(F.col("call_id").alias("need"), "back", "steps")
    several = edges.join(needs.where("count > 1"), "call_id").select("call_id", "need").join(end, "need", "left")
    several = several.select("call_id", F.coalesce("back", "need").alias("back"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")).groupBy("call_id", "back").agg(F.max("steps").alias("steps"))
    waiting = table = scratch.write(several.withColumn("level", F.lit(None).cast("int")), "waiting")
    while waiting.take(1) and new.take(1):
        known = new.select(F.col("call_id").alias("back"), F.col("level").alias("below"))
        joined = scratch.write(waiting.join(known, "back", "left").select("call_id", "back", "steps", F.coalesce("level", F.col("below") + F.col("steps")).alias("level")), "waiting")
        number += 1
        new = keep(joined.groupBy("call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max("level").alias("level")).where("open = 0").select("call_id", "level"), number)
        waiting = joined.join(new.select("call_id"), "call_id", "left_anti")
        scratch.drop(table)
        table = joined
    settled = spark.read.schema(new.schema).parquet(*[f"{path}/round={k}" for k in range(number + 1)])
    at = settled.select(F.col("call_id").alias("back"), "level")
    return settled.unionByName(chains.join(at, "back").select("call_id", (F.col("level") + F.col("steps")).alias("level")))


def _chains(links: DataFrame) -> DataFrame:
    """``links`` (call_id, back, steps; one a call_id) with ``back`` moved to the first call that has no link, and ``steps`` up to it; links in or behind a cycle go."""
    reach, most = 1, links.count()
    while True:
        nearer = links.select(F.col("call_id").alias("back"), F.col("back").alias("further"), F.col("steps").alias("more"))
        joined = links.join(nearer, "back", "left").select("call_id", F.coalesce("further", "back").alias("back"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNull().alias("ended"))
        joined = scratch.write(joined, "chains")
        scratch.drop(links)
        # A link that ended still leads others on, so all stay until none moves, or steps exceed the number of links: a cycle.
        if reach > most or not joined.where("not ended").take(1):
            return joined.where("ended").drop("ended")
        links, reach = joined.drop("ended"), 2 * reach


def _node(call_id: Column) -> Column:
    """One text for a conversation and an identifier in it; null for none."""
    return F.when(call_id.isNotNull(), F.to_json(F.array(F.col("conv_id").cast("string"), call_id)))


def _numbered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``k``, their number within ``node``: counts by range of turns, then places within a range."""
    rows = rows.withColumn("stretch", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / RANGE))
    before = Window.partitionBy("node").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("node", "stretch").count().select("node", "stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("node", "stretch").orderBy("turn", *order)
    return rows.join(sums, ["node", "stretch"]).withColumn("k", F.col("before") + F.row_number().over(inside)).drop("before", "stretch")


def op2_tools(calls: DataFrame, results: DataFrame, schemas: Schemas, unnamed: bool = False) -> DataFrame:
    """conv_id, position, level, call_id, name, errors, json: one row per call, and one per result that has none.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), needs array<string>; ``results``: conv_id, turn, call_id, content.
    ``position`` counts the calls of a conversation in order of level, turn and call_id.
    """
    needs = F.coalesce("needs", F.array().cast("array<string>"))
    one = calls.withColumn("node", _node(F.col("call_id"))).withColumn("needs", F.transform(needs, _node))
    answer = results.withColumn("node", _node(F.col("call_id")))
    named, told = one.where("node is not null"), answer.where("node is not null")
    c = _numbered(named, ("name", "arguments", "needs")).select("node", "k", F.struct("conv_id", "turn", "call_id", "name", "arguments", "needs").alias("c"))
    r = _numbered(told, ("content",)).select("node", "k", F.struct("conv_id", "turn", "call_id", "content").alias("r"))
    linked = c.join(r, ["node", "k"], "full_outer").select("node", "k", "c", "r")
    if unnamed:
        lone = lambda df, c, r: df.where("node is null").select("node", F.lit(1).cast("long").alias("k"), c.alias("c"), r.alias("r"))
        kinds = {f.name: f.dataType for f in linked.schema.fields}
        linked = linked.unionByName(lone(one, F.struct("conv_id", "turn", "call_id", "name", "arguments", "needs"), F.lit(None).cast(kinds["r"])))
        linked = linked.unionByName(lone(answer, F.lit(None).cast(kinds["c"]), F.struct("conv_id", "turn", "call_id", "content")))
    linked = linked.select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.turn", "r.turn").alias("turn"), F.coalesce("c.call_id", "r.call_id").alias("call_id"), F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"), F.col("c.needs").alias("needs"), F.col("r.content").alias("content"), "node", "k", F.col("c").isNotNull().alias("has_call"), F.col("r").isNotNull().alias("has_result"),
    )
    linked = scratch.write(linked, "linked")
    sizes = linked.where("node is not null").groupBy("node").agg(F.count_if("has_call").alias("n_calls"), F.count_if("has_result").alias("n_results"))
    known = linked.where("has_call and node is not null").select(F.col("node").alias("call_id"), "needs")
    levelled = linked.join(sizes, "node", "left").join(levels(known).withColumnRenamed("call_id", "node"), "node", "left")
    levelled = levelled.withColumn("level", F.when(F.col("has_call"), F.col("level")))

    def flag(when: Column, text: str) -> Column:
        return F.when(when, F.lit(text))

    flags = F.filter(
        F.array(
            flag(F.col("node").isNull(), "no identifier"), flag(~F.col("has_call"), "no call"), flag(~F.col("has_result"), "no result"), flag(F.col("n_calls") > 1, "duplicate call"), flag(F.col("n_results") > 1, "duplicate result"),
            flag(F.col("has_call") & F.col("node").isNotNull() & F.col("level").isNull(), "needs not met"),
        ), lambda x: x.isNotNull(),
    )
    errors = F.when(~F.col("has_call"), flags).otherwise(F.concat(errors_of(schemas), flags))
    rows = levelled.withColumn("errors", errors)
    quote = lambda x: F.coalesce(F.to_json(x.cast("variant")), F.lit("null"))
    rows = rows.withColumn(
        "json",
        F.concat(
            F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), quote(F.col("arguments"))), F.lit(',"call_id":'), quote(F.col("call_id")), F.lit(',"errors":'), F.to_json("errors"),
            F.lit(',"name":'), quote(F.col("name")), F.lit(',"result":'), quote(F.col("content")), F.lit("}"),
        ),
    )
    # Positions: counts by conversation and range of turns, running totals over ranges, then places within a range.
    deep = F.coalesce(F.col("level"), F.lit(2**31 - 1))
    rows = rows.withColumn("deep", deep).withColumn("stretch", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / RANGE))
    sums = rows.groupBy("conv_id", "deep", "stretch").count()
    before = Window.partitionBy("conv_id").orderBy("deep", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("deep").alias("_deep"), F.col("stretch").alias("_stretch"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = rows.join(sums, F.expr("conv_id <=> _conv and deep = _deep and stretch = _stretch"))
    inside = Window.partitionBy("conv_id", "deep", "stretch").orderBy("turn", "call_id", "k", "has_call", "name", "arguments", "content")
    return placed.select("conv_id", (F.col("before") + F.row_number().over(inside)).alias("position"), "level", "call_id", "name", "errors", "json")


#: Schemas of the view below.
VIEW_SCHEMAS: Schemas = {
    "lookup": {"query": ("STRING", True), "limit": ("BIGINT", True), "exact": ("BOOLEAN", False)},
    "measure": {"text": ("STRING", True), "unit": ("STRING", False)},
    "note": {"body": ("STRING", True)},
}


def conversation_view(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain chat turns, whole texts.

    Every assistant turn is a call ``c<conv_id>-<turn>`` of a tool by turn; its arguments hold its text, some of them
    against the schema; of three, two need the call two turns before. Every user turn after the first is the result of the call of the turn before.
    """
    t = conversations.select("conv_id", "turn", "role", "text")
    name = F.element_at(F.array(F.lit("lookup"), F.lit("measure"), F.lit("note"), F.lit("erase")), ((F.col("conv_id") + F.col("turn")) % 7 % 4 + 1).cast("int"))
    key = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    calls = t.where("role = 'assistant'").withColumn("name", name)
    size = F.length("text").cast("long")
    look = F.when(F.col("conv_id") % 5 == 0, F.to_json(F.struct(F.col("text").alias("query"), size.cast("string").alias("limit")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit"), (size > 100).alias("exact"))))
    measure = F.when(F.col("conv_id") % 5 == 1, F.to_json(F.struct(F.lit("chars").alias("unit"), F.lit(1).alias("depth")))).otherwise(F.to_json(F.struct(F.lit("chars").alias("unit"), F.col("text").alias("text"))))
    body = F.when(F.col("conv_id") % 5 == 2, F.lit("{")).otherwise(F.to_json(F.struct(F.col("text").alias("body"))))
    arguments = F.when(F.col("name") == "lookup", look).when(F.col("name") == "measure", measure).otherwise(body)
    needs = F.when((F.col("turn") > 2) & (F.col("turn") % 3 != 0), F.array(key(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = calls.select("conv_id", "turn", key(F.col("turn")).alias("call_id"), "name", arguments.alias("arguments"), needs.alias("needs"))
    results = t.where("role = 'user' and turn > 0").select("conv_id", "turn", key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '-' || turn AS call_id,
         (['lookup', 'measure', 'note', 'erase'])[CAST((conv_id + turn) % 7 % 4 + 1 AS INTEGER)] AS name,
         CASE WHEN turn > 2 AND turn % 3 != 0 THEN 'c' || conv_id || '-' || (turn - 2) END AS need
  FROM conversations WHERE role = 'assistant'),
results AS (
  SELECT conv_id, turn, text AS content, 'c' || conv_id || '-' || (turn - 1) AS call_id
  FROM conversations WHERE role = 'user' AND turn > 0),
levels AS (
  SELECT call_id, 0 AS level FROM calls WHERE need IS NULL
  UNION ALL SELECT c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.need = l.call_id),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
         c.name, c.text, r.content, c.call_id IS NOT NULL AS has_call, r.call_id IS NOT NULL AS has_result
  FROM calls c FULL JOIN results r ON c.call_id = r.call_id),
judged AS (
  SELECT k.*, l.level,
         CASE WHEN name = 'lookup' AND k.conv_id % 5 = 0 THEN '{"limit":"' || length(text) || '","query":' || to_json(text) || '}'
              WHEN name = 'lookup' THEN '{"exact":' || (length(text) > 100) || ',"limit":' || length(text) || ',"query":' || to_json(text) || '}'
              WHEN name = 'measure' AND k.conv_id % 5 = 1 THEN '{"depth":1,"unit":"chars"}'
              WHEN name = 'measure' THEN '{"text":' || to_json(text) || ',"unit":"chars"}'
              WHEN NOT has_call THEN 'null'
              WHEN k.conv_id % 5 = 2 THEN '"{"'
              ELSE '{"body":' || to_json(text) || '}' END AS arguments,
         list_filter([
           CASE WHEN name = 'erase' THEN 'unknown tool' END,
           CASE WHEN name = 'note' AND k.conv_id % 5 = 2 THEN 'malformed arguments' END,
           CASE WHEN name = 'lookup' AND k.conv_id % 5 = 0 THEN 'type of limit' END,
           CASE WHEN name = 'measure' AND k.conv_id % 5 = 1 THEN 'missing text' END,
           CASE WHEN name = 'measure' AND k.conv_id % 5 = 1 THEN 'unknown depth' END,
           CASE WHEN NOT has_call THEN 'no call' END,
           CASE WHEN NOT has_result THEN 'no result' END,
           CASE WHEN has_call AND l.level IS NULL THEN 'needs not met' END], lambda x: x IS NOT NULL) AS errors
  FROM linked k LEFT JOIN levels l ON k.call_id = l.call_id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 2147483647), turn, call_id) AS position,
       level, call_id, name, errors,
       '{"arguments":' || arguments || ',"call_id":"' || call_id || '","errors":' || to_json(errors)
       || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content), 'null') || '}' AS json
FROM judged
"""
