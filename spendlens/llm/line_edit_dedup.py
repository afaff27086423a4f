"""Near-duplicate lines by a segment-partition edit join.

A line is cut into threshold-plus-one segments.  Two lines within that many edits agree on one
segment, up to a shift that the lengths bound, so substrings at those few places probe an index of
segments by length.  Candidates are verified by edit distance in a diagonal band held in one bit
vector.  DataFrame expressions only; texts are dealt out once, by document, and used from there
for the segments, for verification and for the cleaned texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spendlens.llm.shared import packed

_LINE_ID = "(xxhash64({}) & 1099511627775L)"


def cuts(n: str, shorter: int, count: int) -> dict[str, str]:
    """SQL for the ends of ``count`` even segments of a line ``shorter`` than ``n`` characters."""
    return {f"_c{shorter}_{i}": f"CAST(({n} - {shorter}) * {i} div {count} AS int)" for i in range(count + 1)}


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) under which a line meets a segment of a line as long or shorter.

    With segment i of a line shorter by d agreeing at a shift s, at least |s| edits lie left of it
    and |d - s| right; at most i of them need to be left and edits - i right of the first segment
    that agrees (multi-match-aware selection).
    """
    return [(d, i, s) for d in range(edits + 1) for i in range(edits + 1)
            for s in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def edit_distance(a: str, b: str, edits: int) -> str:
    """SQL for the edit distance of character code arrays ``a`` and ``b``, right up to ``edits``.

    One column of the distance matrix per character of ``b``; of each only the rows within
    ``edits`` of the diagonal, as bits of vertical differences (Myers 1999, Hyyrö 2003).  The band
    moves down a row per column, so bit r stands for row j - edits + r.  The cell followed runs down
    the band's lower edge to the last row and then along it.
    """
    k, full = edits, (1 << (2 * edits + 1)) - 1
    match = " | ".join(f"IF(get({a}, j - {k} - 1 + {r}) <=> get({b}, j - 1), {1 << r}L, 0L)" for r in range(2 * k + 1))
    # Above the first row there are no characters: negative positions give null on one side only.
    columns = f"transform(sequence(1, size({b})), j -> named_struct('j', j, 'x', {match}))"
    zero = "(((((e.x & s.vp) + s.vp) ^ s.vp) | e.x | s.vn) & {full}L)".format(full=full)
    hp, hn = f"((s.vn | ~(d | s.vp)) & {full}L)", "(d & s.vp)"
    step = (f"named_struct('vp', ({hn} | ~(shiftright(d, 1) | {hp})) & {full}L, 'vn', shiftright(d, 1) & {hp}, "
            f"'n', s.n + IF(e.j + {k} <= size({a}), 1 - (shiftright(d, {2 * k}) & 1L), "
            f"(shiftright({hp}, size({a}) - e.j + {k}) & 1L) - (shiftright({hn}, size({a}) - e.j + {k}) & 1L)))")
    first = full & ~((1 << k) - 1)
    return (f"IF(abs(size({a}) - size({b})) > {k}, {k + 1}L, IF(size({b}) = 0, CAST(size({a}) AS bigint), aggregate({columns}, "
            f"named_struct('vp', {first}L, 'vn', 0L, 'n', CAST(least(size({a}), {k}) AS bigint)), "
            f"(s, e) -> transform(array({zero}), d -> {step})[0], s -> s.n)))")


def codes(line: str) -> str:
    return f"transform(split({line}, ''), c -> ascii(c))"


def _document() -> Column:
    """Place of a document in the corpus as one number: null ids first, then ids, then a hash of the text.

    The last 28 bits are left for the line, more than an array holds.  Before them a null id takes
    64 bits of the hash and others 34, so rows that share an id but not the text are told apart.
    """
    # Never null, so no null filter tells the uses of the dealt texts apart.
    return F.expr("coalesce(IF(doc_id IS NULL, (CAST(xxhash64(text) AS decimal(20,0)) + 9223372036854775808BD) * 268435456BD "
                  "- 90000000000000000000000000000000000000BD, CAST(CAST(doc_id AS bigint) AS decimal(20,0)) * 4611686018427387904BD "
                  "+ CAST(shiftrightunsigned(xxhash64(text), 30) AS decimal(11,0)) * 268435456BD), 0BD)")


def _doc_id() -> Column:
    """The id that a document's place was made of."""
    return F.expr("IF(_d < -50000000000000000000000000000000000000BD, NULL, "
                  "CAST((_d - pmod(_d, 4611686018427387904BD)) / 4611686018427387904BD AS bigint))")


def _place() -> Column:
    """Place of a line in the corpus as one number: that of its document, then lines."""
    return F.expr("_d + CAST(_i AS decimal(10,0))")


def _at(place: str) -> list[Column]:
    """Place of the document and line number of a place."""
    return [F.expr(f"{place} - pmod({place}, 268435456BD)").alias("_d"), F.expr(f"CAST(pmod({place}, 268435456BD) AS int)").alias("_i")]


def _segment_keys(edits: int) -> Column:
    """Index keys (own) and probe keys of a line: 56 bits of its length as met, segment and substring.

    The line's 40-bit id goes with each, shifted by a bit that tells index keys.
    """
    keys = []
    for short, i, shift in probe_places(edits):
        start, end = f"_c{short}_{i}", f"_c{short}_{i + 1}"
        keys.append(f"named_struct('tag', {'_own' if short == shift == 0 else '_probe'}, 'key', "
                    f"xxhash64(_c{short}_{edits + 1}, {i}, substring(_line, {start} + {1 + shift}, {end} - {start})) & 72057594037927935L)")
    return F.expr(f"array({', '.join(keys)})")


def _firsts(d: DataFrame, min_chars: int) -> DataFrame:
    """``(id, _first)``: each distinct line of the length in question and its first place.

    Lines are told apart by 104 bits of hash; ``id`` is 40 of them.
    """
    lines = d.select("_d", F.posexplode(F.split("text", "\n")).alias("_i", "_line")).where(F.char_length("_line") >= min_chars)
    lines = lines.select(_place().alias("_p"), F.expr(_LINE_ID.format("_line")).alias("id"),
                         F.xxhash64(F.lit("line"), "_line").alias("_h"))
    return lines.groupBy("id", "_h").agg(F.min("_p").alias("_first")).select("id", "_first")


def repeated(d: DataFrame, firsts: DataFrame, lists: DataFrame, edits: int) -> DataFrame:
    """``(_d, _near)``: first places of lines that are within ``edits`` of an earlier line, by document.

    Lines meet by key only where a key has several; the join on keys compares the lines themselves,
    so a key that many lines share emits links and no candidates.
    """
    lines = d.join(lists.hint("shuffle_hash"), "_d").select("_firsts", F.split("text", "\n").alias("_all"))
    lines = lines.select(F.explode(F.expr("transform(_firsts, x -> named_struct('id', x.id, 'line', get(_all, x._i)))")).alias("_x"))
    # Only the line meant counts, should two texts of a doc_id have the same hash.
    lines = lines.select("_x.id", F.col("_x.line").alias("_line")).where(_LINE_ID.format("_line") + " = id")
    lines = lines.withColumn("_n", F.char_length("_line"))
    ends = {k: F.expr(v) for short in range(edits + 1) for k, v in cuts("_n", short, edits + 1).items()}
    lines = lines.withColumns(ends | {"_own": F.expr("coalesce(id, 0L) * 2 + 1"), "_probe": F.expr("coalesce(id, 0L) * 2")})
    keyed = lines.select(F.explode(_segment_keys(edits)).alias("_key")).select("_key.tag", "_key.key").repartition("key")
    crowd = keyed.groupBy("key").agg(F.count("*").alias("_m"), F.max(F.col("tag").bitwiseAND(F.lit(1))).alias("_own")).where("_m > 1 AND _own = 1")
    met = keyed.join(crowd.select("key").hint("shuffle_hash"), "key")
    # Bit operations cannot make nulls, so no null filter tells the uses of these rows apart and they are made once.
    met = met.select("key", F.shiftright("tag", 1).alias("id"), F.col("tag").bitwiseAND(F.lit(1)).alias("own"))
    # The lines that meet others, fetched by their first places.
    wanted = met.select("id").distinct().join(firsts, "id").select("id", *_at("_first"), "_first")
    wanted = wanted.groupBy("_d").agg(F.collect_set(F.struct("id", "_i", "_first")).alias("_w"))
    texts = d.join(wanted.hint("shuffle_hash"), "_d").select("_w", F.split("text", "\n").alias("_all"))
    texts = texts.select(F.explode(F.expr(
        "transform(_w, w -> named_struct('id', w.id, 'first', w._first, 'line', get(_all, w._i)))")).alias("_x")).select("_x.*").where(_LINE_ID.format("line") + " = id")
    full = met.join(texts.dropDuplicates(["id", "first"]), "id").select("key", "own", "first", "line")
    a = full.select("key", F.col("own").alias("oa"), F.col("first").alias("fa"), F.col("line").alias("a"))
    b = full.select("key", F.col("own").alias("ob"), F.col("first").alias("fb"), F.col("line").alias("b"))
    # An index key on the left; the sum keeps the two sides alike, so that they are made once.
    meet = (2 * F.col("oa") + F.col("ob") >= 2) & (F.col("fa") != F.col("fb")) & ((F.col("oa") + F.col("ob") < 2) | (F.col("fa") < F.col("fb")))
    pairs = a.join(b, "key").where(meet & (F.levenshtein("a", "b", edits) >= 0)).dropDuplicates(["fa", "fb"])
    # The number keeps the filter above the arrays of characters, which it would else make anew for each step.
    pairs = pairs.select(F.greatest("fa", "fb").alias("_late"), F.expr(codes("a")).alias("a"), F.expr(codes("b")).alias("b"),
                         F.monotonically_increasing_id().alias("_no"))
    near = pairs.where((F.col("_no") >= 0) & F.expr(f"{edit_distance('a', 'b', edits)} <= {edits}")).select("_late").distinct()
    return near.select(*_at("_late")).groupBy("_d").agg(F.collect_set("_i").alias("_near"))


def _cleaned(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``_row`` (struct of the columns of ``docs`` with the cleaned text), ``_lines`` and ``_dropped``."""
    if min_chars <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits")
    d = docs.select(_document().alias("_d"), "text")
    firsts = _firsts(d, min_chars)
    lists = firsts.select("id", *_at("_first")).groupBy("_d").agg(F.collect_set(F.struct("_i", "id")).alias("_firsts"))
    near = repeated(d, firsts, lists, edits)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Without further columns this is dealt out like the texts above, and Spark deals them once.
    rows = docs.select(_document().alias("_d"), "text", *([packed(others).alias("_rest")] if others else []))
    rows = rows.join(lists.hint("shuffle_hash"), "_d", "left").join(near.hint("shuffle_hash"), "_d", "left")
    none = "CAST(array() AS array<int>)"
    rows = rows.withColumn("_all", F.split("text", "\n"))
    rows = rows.withColumn("_long", F.expr(f"filter(transform(_all, (x, i) -> IF(char_length(x) >= {min_chars}, i, -1)), i -> i >= 0)"))
    rows = rows.withColumn("_drops", F.expr(
        f"array_except(_long, array_except(coalesce(transform(_firsts, x -> x._i), {none}), coalesce(_near, {none})))"))
    stay = F.expr("array_join(transform(array_except(sequence(0, size(_all) - 1), _drops), i -> _all[i]), '\\n')")
    dropped = F.coalesce(F.size("_drops"), F.lit(0))
    text = F.when(dropped > 0, stay).otherwise(F.col("text"))
    made = {"doc_id": _doc_id().cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in others:
        made["n_chars"] = F.when(dropped > 0, F.char_length(text)).otherwise(F.col("_rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    row = F.struct(*[(made[c] if c in made else F.col("_rest").getField(c)).alias(c) for c in docs.columns])
    return rows.select(row.alias("_row"), F.when(F.col("text").isNull(), 0).otherwise(F.size("_all")).cast("long").alias("_lines"),
                       F.when(F.col("text").isNull(), 0).otherwise(dropped).cast("long").alias("_dropped"))


def deduplicated(docs: DataFrame, edits: int = 2, min_chars: int = 20) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    A line of ``min_chars`` characters or more goes if an equal line stands earlier in the corpus,
    or if an earlier line, by first places, is within ``edits`` edits (whether that one stays or
    not).  Shorter lines stay.  A document that loses lines is joined again by newlines from those
    that stay, or becomes empty; others keep their text as it is, null included (no lines).  Rows
    alike in doc_id and text are one document and stay alike.  Rows that share a doc_id only are
    documents of their own, in order of a hash of the text; null ids come before all others.
    ``n_chars`` follows where present.  Other columns stay as they are, but for the two that are added, which replace
    columns of their names.  An empty table gives no rows.
    """
    out = _cleaned(docs, edits, min_chars)
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*kept, F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat an earlier one up to two edits."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; documents of which nothing is left go.

    ``text`` changes, and ``n_chars`` with it; all other columns come back as they were, whatever their names.
    """
    # A filter on the text would be pushed below and split it again for each line; the number keeps it here.
    out = _cleaned(docs, 2, 20).withColumn("_no", F.monotonically_increasing_id())
    return out.where((F.col("_no") >= 0) & ((F.col("_dropped") == 0) | (F.col("_row.text") != ""))).select("_row.*")
