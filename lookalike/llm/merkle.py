"""Operator 7: document fingerprints as Merkle trees over sections, paragraphs and spans.

Paragraphs are the lines of a text.  A paragraph is cut into sentences and these into spans of up
to ``SPAN_WORDS`` words; a span's hash is a leaf, and one more leaf, the hash of the whole line, stands for
the blanks and signs between the spans.  A paragraph's node is the hash of its leaves in order, a
section's that of its paragraphs' nodes, the root that of the sections' nodes.  A section ends after a
blank paragraph, or after a paragraph whose node starts with one of two hex digits: boundaries depend
on content alone, so an edit moves no boundary beyond its own section.

The fingerprint is a string: root ``#`` sections joined by ``|``; a section is its hash ``=`` its
paragraphs joined by ``,``; a paragraph is its hash followed by ``.leaf`` for every leaf.  Equal
roots mean equal texts; ``likeness`` compares leaves; ``changed`` follows differing branches down
to the paragraphs that differ.  Everything is a DataFrame expression.

Edge cases: NULL text counts as empty (one blank paragraph without leaves); equal texts have equal
fingerprints, likeness 1; a text without words is like nothing but its equals; the next document
of rows with equal ids is the one with the next larger text; a NULL id comes after all others; a
single document is its own next one; extra columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, text_or_empty, written

SPAN_WORDS = 3
#: A sentence's spans: up to SPAN_WORDS words in a row, none across the end of a sentence.
SPAN = r"[^ \t.!?]+(?:[ \t]+[^ \t.!?]+){0,2}[.!?]*"
LEAF_HEX, NODE_HEX = 8, 12
LOWEST = -(1 << 63)
#: Documents are dealt to windows of this many consecutive ids.
IDS_PER_WINDOW = 512
#: Heads of windows that may be broadcast (16 bytes each).
BROADCAST_HEADS = 250_000


def _leaves(paragraph):
    return F.transform(F.regexp_extract_all(paragraph, F.lit(SPAN), F.lit(0)),
                       lambda s: F.substring(F.md5(s), 1, LEAF_HEX))


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paragraph(paragraph):
    """node.leaf.leaf...; a blank paragraph ends a section, as do two of sixteen hash values."""
    def with_node(leaves, node):
        ends = (F.btrim(paragraph) == "") | F.substring(node, 1, 1).isin("0", "1")
        return F.concat(node, F.when(leaves == "", F.lit("")).otherwise(F.concat(F.lit("."), leaves)),
                        F.when(ends, F.lit("|")).otherwise(F.lit(",")))

    def with_leaves(leaves):
        whole = F.concat(F.lit("p"), leaves, F.lit("."), F.md5(paragraph))
        return _let(F.substring(F.md5(whole), 1, NODE_HEX), lambda node: with_node(leaves, node))
    return _let(F.array_join(_leaves(paragraph), "."), with_leaves)


def fingerprint(text):
    """Fingerprint string of a text column."""
    rows = F.array_join(F.transform(F.split(text, "\n"), _paragraph), "")
    sections = F.filter(F.split(rows, r"\|"), lambda s: s != "")
    section = lambda s: F.concat(
        F.substring(F.md5(F.array_join(F.regexp_extract_all(s, F.lit(f"(?:^|,)([0-9a-f]{{{NODE_HEX}}})"), F.lit(1)), ",")), 1, NODE_HEX),
        F.lit("="), F.rtrim(s, F.lit(",")))
    nodes = lambda body: F.regexp_extract_all(body, F.lit(f"(?:^|[|])([0-9a-f]{{{NODE_HEX}}})="), F.lit(1))
    return _let(F.array_join(F.transform(sections, section), "|"),
                lambda body: F.concat(F.md5(F.concat(F.lit("r"), F.array_join(nodes(body), ","))), F.lit("#"), body))


def root(fp):
    return F.substring_index(fp, "#", 1)


def leaves(fp):
    """Leaf hashes of a fingerprint."""
    return F.regexp_extract_all(fp, F.lit(rf"\.([0-9a-f]{{{LEAF_HEX}}})"), F.lit(1))


def likeness(a, b):
    """Share of leaves that two fingerprints have in common (Dice over distinct leaves), 1 for
    equal roots."""
    return _dice(root(a) == root(b), leaves(a), leaves(b))


def _dice(same, left, right):
    left, right = F.array_distinct(left), F.array_distinct(right)
    return F.when(same, F.lit(1.0)).otherwise(F.coalesce(
        2.0 * F.size(F.array_intersect(left, right)) / F.nullif(F.size(left) + F.size(right), F.lit(0)), F.lit(0.0)))


def changed(a, b):
    """Paragraph hashes of ``a`` in sections that ``b`` has not, and that ``b`` has not either:
    the branches where the two trees differ."""
    def sections(fp):
        return F.split(F.substring_index(fp, "#", -1), r"\|")

    def node(s):
        return F.substring_index(s, "=", 1)

    def paragraphs(s):
        return F.transform(F.split(F.substring_index(s, "=", -1), ","), lambda p: F.substring(p, 1, NODE_HEX))
    theirs = F.transform(sections(b), node)
    open_a = F.filter(sections(a), lambda s: ~F.array_contains(theirs, node(s)))
    return F.array_except(F.flatten(F.transform(open_a, paragraphs)), F.flatten(F.transform(sections(b), paragraphs)))


def fingerprints(df: DataFrame, column: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``column`` (replaces a column named ``out``)."""
    return df.withColumn(out, fingerprint(text_or_empty(column)))


def with_next(df: DataFrame, columns: list[str], ids: str = "doc_id") -> DataFrame:
    """Add ``next_<c>`` for each column: its value in the next row by descending id (after the last:
    the first).  Rows are dealt to windows of IDS_PER_WINDOW ids; the first row of every window is
    also dealt to the window before it, so that no window spans all rows."""
    order = [F.desc("_id"), *[F.asc(c) for c in columns]]
    rows = df.withColumn("_id", F.coalesce(F.col(ids).cast("long"), F.lit(LOWEST)))
    rows = rows.withColumn("_window", F.floor(F.col("_id") / IDS_PER_WINDOW))
    # windows in use and the window that comes before each (the one with the next larger ids);
    # one row per window, numbered within blocks of windows and across the blocks
    used = rows.groupBy("_window").agg(F.max("_id").alias("_head")).withColumn(
        "_block", F.floor(F.col("_window") / IDS_PER_WINDOW))
    used = written(used, "fingerprint-windows")
    blocks = used.groupBy("_block").agg(F.min("_window").alias("_low"))
    everywhere = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = blocks.select("_block", F.lead("_low").over(Window.orderBy("_block")).alias("_above"),
                          F.first("_low").over(everywhere).alias("_wrap"))
    heads = (used.join(above, "_block")
             .select("_head", F.coalesce(F.lead("_window").over(Window.partitionBy("_block").orderBy("_window")),
                                         "_above", "_wrap").alias("_to")))
    if used.count() <= BROADCAST_HEADS:  # two numbers each; a shuffle join beyond
        heads = F.broadcast(heads)
    own = rows.withColumn("_copy", F.lit(0))
    # of rows with the head's id, the one with the smallest values comes first
    copies = rows.join(heads, F.col("_id") == F.col("_head")).withColumn("_window", F.col("_to")).drop("_head", "_to")
    both = own.unionByName(copies.withColumn("_copy", F.lit(1)))
    over = Window.partitionBy("_window").orderBy("_copy", *order)
    return (both.withColumns({f"next_{c}": F.lead(c).over(over) for c in columns})
            .where(F.col("_copy") == 0).drop("_id", "_window", "_copy"))


def edited(text, following):
    """The last third of a text replaced by as many code points of the start of another."""
    n = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - n), F.substring(following, F.lit(1), n))


def digest(docs: DataFrame) -> DataFrame:
    """Query form: fingerprints of every text and its edited text, and their likeness."""
    prepare(docs.sparkSession)
    # only texts are dealt to the windows: a fingerprint has about half a text's size
    out = with_next(docs.select("doc_id", text_or_empty().alias("text")), ["text"])
    out = out.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    for of in ("text", "edited", "next_text"):
        out = fingerprints(out, of, {"text": "fingerprint"}.get(of, f"{of.removesuffix('_text')}_fingerprint"))
    return out.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def _sql_fingerprint(text: str) -> str:
    leaves = f"coalesce(list_aggregate(list_transform(regexp_extract_all(p, '{SPAN}'), lambda s: substring(md5(s), 1, {LEAF_HEX})), 'string_agg', '.'), '')"
    paragraph = (f"list_transform([{leaves}], lambda l: list_transform([substring(md5('p' || l || '.' || md5(p)), 1, {NODE_HEX})], lambda n: "
                 "n || CASE WHEN l = '' THEN '' ELSE '.' || l END || "
                 "CASE WHEN trim(p) = '' OR substring(n, 1, 1) IN ('0', '1') THEN '|' ELSE ',' END)[1])[1]")
    rows = f"list_aggregate(list_transform(string_split({text}, chr(10)), lambda p: {paragraph}), 'string_agg', '')"
    section = (f"substring(md5(list_aggregate(regexp_extract_all(s, '(?:^|,)([0-9a-f]{{{NODE_HEX}}})', 1), 'string_agg', ',')), 1, {NODE_HEX}) "
               f"|| '=' || rtrim(s, ',')")
    body = (f"list_aggregate(list_transform(list_filter(string_split({rows}, '|'), lambda s: s <> ''), lambda s: {section}), 'string_agg', '|')")
    return (f"list_transform([{body}], lambda b: md5('r' || list_aggregate(regexp_extract_all(b, '(?:^|[|])([0-9a-f]{{{NODE_HEX}}})=', 1), "
            "'string_agg', ',')) || '#' || b)[1]")


def _sql_likeness(a: str, b: str) -> str:
    leaf = lambda x: f"list_distinct(regexp_extract_all({x}, '\\.([0-9a-f]{{{LEAF_HEX}}})', 1))"
    return (f"CASE WHEN split_part({a}, '#', 1) = split_part({b}, '#', 1) THEN 1.0::DOUBLE "
            f"WHEN len({leaf(a)}) + len({leaf(b)}) = 0 THEN 0.0::DOUBLE "
            f"ELSE 2.0::DOUBLE * len(list_intersect({leaf(a)}, {leaf(b)})) / (len({leaf(a)}) + len({leaf(b)})) END")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text),
                                    first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS next_text FROM d),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) AS edited FROM n),
f AS (SELECT *, {_sql_fingerprint('text')} AS fingerprint, {_sql_fingerprint('edited')} AS edited_fingerprint,
             {_sql_fingerprint('next_text')} AS next_fingerprint FROM e)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       {_sql_likeness('fingerprint', 'edited_fingerprint')} AS near_edited,
       {_sql_likeness('fingerprint', 'next_fingerprint')} AS near_next
FROM f
"""
