"""Line dedup with DataFrame functions only: exact copies, and near copies by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, work_folder

#: ASCII white space, as in the other operators, where it isn't one space already.
_WS = r"[ \t\n\x0B\f\r][ \t\n\x0B\f\r]+|[\t\n\x0B\f\r]"
#: Segments of a line; one edit leaves all but one of them as they are.
SEGMENTS = 4
#: Words of the first, coarse keys. One edit in 2 * OUTER words or more leaves the first or the last OUTER as they are.
OUTER = 5


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, _WS, " "))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, rid, body of every row. rid tells rows with equal keys and other texts apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), body).alias("rid"), body.alias("body"))


def _within_one(a: Column, b: Column) -> Column:
    """True if one word added, removed or replaced turns the word list a into b (or if they are equal)."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n, m = F.size(short), F.size(long)
    same = F.zip_with(F.slice(long, F.lit(1), F.greatest(n, F.lit(1))), short, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False)).cast("int")  # from 1; 0 if one begins with the other
    after_long = F.slice(long, at + 1, F.greatest(m, F.lit(1)))
    after_short = F.when(n == m, F.slice(short, at + 1, F.greatest(n, F.lit(1)))).otherwise(F.slice(short, F.greatest(at, F.lit(1)), F.greatest(n, F.lit(1))))
    return (m - n <= 1) & F.when(at == 0, True).otherwise(after_long == after_short)


def _near_lines(docs: DataFrame, groups: DataFrame, key: str, text: str, near_words: int, work: str) -> DataFrame:
    """h1, h2 of distinct lines that an earlier distinct line equals up to one word.

    Coarse keys (the first and the last words) tell which lines can have a partner; only their texts are fetched.
    Segment keys then tell in which quarter the edit must be, and only that quarter's variants are emitted: each word
    left out, with its place where a word is replaced. Every key's group stands for its earliest line, so groups of
    any size give as many rows as they have members. Pairs with that line are checked word by word.
    """
    outer = groups.filter(F.col("k1").isNotNull()).select("pos", "h1", "h2", F.explode(F.array("k1", "k2")).alias("ok"))
    met = outer.groupBy("ok").count().filter(F.col("count") > 1).select("ok")
    chosen = outer.join(met, "ok", "left_semi").select("pos.*", "h1", "h2").distinct()
    per_row = chosen.groupBy("rid", "k").agg(F.collect_list(F.struct("no", "h1", "h2")).alias("picks"))
    d = _lines(docs, key, text).alias("d")
    p = per_row.hint("shuffle_hash").alias("p")  # else whole texts are sorted
    found = d.join(p, (F.col("d.rid") == F.col("p.rid")) & F.col("d.k").eqNullSafe(F.col("p.k")))
    found = found.select("d.k", "d.rid", F.split("d.body", "\n").alias("lines"), "p.picks")
    picked = F.transform("picks", lambda x: F.struct(x["no"].alias("no"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.get("lines", x["no"]).alias("line")))
    found = found.select("k", "rid", F.explode(picked).alias("pick"))
    words = F.split(_plain(F.col("pick.line")), " ")
    found = found.select(F.struct("k", "rid", F.col("pick.no").alias("no")).alias("pos"), "pick.h1", "pick.h2", words.alias("words"))
    texts = stored(found, work, "texts")

    # b: words before the segment, e: words after it, of a line that is or becomes `shorter` words long.
    cuts = F.explode(F.expr(f"flatten(transform(array(size(words), size(words) - 1), l -> transform(sequence(0, {SEGMENTS - 1}), j -> struct(l AS l, j AS j, int(floor(j * l / {SEGMENTS})) AS b, l - int(floor((j + 1) * l / {SEGMENTS})) AS e))))"))
    cut = texts.select("pos", "h1", "h2", "words", cuts.alias("c")).filter(F.col("c.l") >= near_words)
    seg_key = F.expr("xxhash64(c.l, c.j, concat_ws(' ', slice(words, 1, c.b)), concat_ws(' ', slice(words, size(words) - c.e + 1, c.e)))")
    middle = F.expr("slice(words, c.b + 1, size(words) - c.b - c.e)")
    cut = cut.select("pos", "h1", "h2", seg_key.alias("sk"), middle.alias("seg"), (F.size("words") == F.col("c.l")).alias("whole"))
    met = cut.groupBy("sk").count().filter(F.col("count") > 1).select("sk")
    cut = cut.join(met, "sk", "left_semi")
    without = "concat_ws(' ', slice(seg, 1, i), slice(seg, i + 2, size(seg)))"
    every = "sequence(0, size(seg) - 1)"
    variants = F.expr(
        f"CASE WHEN whole THEN concat(transform({every}, i -> struct('S' AS kind, xxhash64(sk, 'S', i, {without}) AS vk)), array(struct('W' AS kind, xxhash64(sk, 'D', concat_ws(' ', seg)) AS vk)))"
        f" ELSE transform({every}, i -> struct('D' AS kind, xxhash64(sk, 'D', {without}) AS vk)) END"
    )
    v = stored(cut.select("pos", "h1", "h2", F.explode(variants).alias("v")).select("pos", "h1", "h2", "v.kind", "v.vk"), work, "variants")
    line = F.struct("pos", "h1", "h2")
    first = v.groupBy("vk").agg(*(F.min(F.when(F.col("kind") == x, line)).alias(x) for x in "SWD"), F.count("*").alias("n")).filter("n > 1")
    partner = F.when(F.col("kind") == "S", F.col("S")).when(F.col("kind") == "D", F.col("W")).otherwise(F.col("D"))
    pairs = v.join(first.drop("n"), "vk").select("pos", "h1", "h2", partner.alias("m")).filter(F.col("m.pos") < F.col("pos"))
    pairs = pairs.select("h1", "h2", F.col("m.h1").alias("g1"), F.col("m.h2").alias("g2")).distinct()
    mine = texts.select("h1", "h2", F.col("words").alias("a"))
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("b"))
    return pairs.join(mine, ["h1", "h2"]).join(other, ["g1", "g2"]).filter(_within_one(F.col("a"), F.col("b"))).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", near_words: int = 10, drop_emptied: bool = False, count_column: str = "n_dropped_lines") -> DataFrame:
    """Remove lines that an earlier line of the table equals, exactly or within the edit bound.

    Lines are what stands between \\n; they are compared as lists of words (runs of anything but ASCII white space),
    and come in order of key (nulls first), then of a hash of key and text, then of their place in the text. The edit
    bound is one word (added, removed or replaced) for lines of near_words (10 at least) words or more, and none for
    shorter lines. A line goes if any earlier line is within the bound, whether that one stays or not. Lines without a word
    stay.

    Returns all columns of docs with the rest of the text, and count_column (long, lines removed). With drop_emptied,
    rows that had words and have none left go too. Null texts stay null and empty ones empty. Rows that agree in key
    and text count as one document, and keep the same lines. An empty table gives an empty result.
    """
    if near_words < 2 * OUTER:
        raise ValueError(f"near_words must be {2 * OUTER} at least")
    work = work_folder(docs.sparkSession)
    lines = _lines(docs, key, text).select("k", "rid", F.posexplode(F.split("body", "\n")).alias("no", "line"))
    lines = lines.select("k", "rid", "no", _plain(F.col("line")).alias("t"))
    is_long = F.substring_index("t", " ", near_words - 1) != F.col("t")
    coarse = (F.when(is_long, F.xxhash64(F.lit(s), F.substring_index("t", " ", s * OUTER))) for s in (1, -1))
    k1, k2 = coarse
    lines = stored(lines.select("k", "rid", "no", F.when(F.col("t") != "", F.xxhash64("t")).alias("h1"), F.xxhash64(F.lit(1), F.col("t"), F.lit(2)).alias("h2"), k1.alias("k1"), k2.alias("k2")), work, "lines").filter("h1 IS NOT NULL")  # filtered before, each line would be cleaned twice
    pos = F.struct("k", "rid", "no")
    groups = lines.groupBy("h1", "h2").agg(F.min(pos).alias("pos"), F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
    groups = stored(groups, work, "groups")
    near = _near_lines(docs, groups, key, text, near_words, work).withColumn("near", F.lit(True))
    touched = groups.select("h1", "h2", "pos", "n").join(near, ["h1", "h2"], "left").filter("n > 1 OR near").select("h1", "h2", F.col("pos").alias("first"), "near")
    gone = lines.select("k", "rid", "no", "h1", "h2").join(touched, ["h1", "h2"]).filter(F.col("near") | (pos != F.col("first")))
    gone = stored(gone.groupBy("rid", "k").agg(F.array_sort(F.collect_set("no")).alias("gone")), work, "gone")
    dropped(docs.sparkSession, work, "lines", "groups", "texts", "variants")

    rid = F.xxhash64(F.col(f"d.`{key}`"), F.coalesce(F.col(f"d.`{text}`"), F.lit("")))
    hashed = gone.hint("shuffle_hash").alias("g")
    both = docs.alias("d").join(hashed, (rid == F.col("g.rid")) & F.col(f"d.`{key}`").eqNullSafe(F.col("g.k")), "left")
    both = both.withColumn("_cut", F.when(F.col("g.gone").isNotNull(), F.split(F.col(f"d.`{text}`"), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), F.col("g.gone"))
    rest = F.when(F.col("g.gone").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_cut", i)), "\n"))
    if drop_emptied:
        both = both.filter(F.col("g.gone").isNull() | rest.rlike(r"[^ \t\n\x0B\f\r]"))
    columns = [rest.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns if c != count_column]
    return both.select(*columns, F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias(count_column))
