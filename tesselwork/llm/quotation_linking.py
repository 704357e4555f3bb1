"""Quotation linking of chat and mail threads, with DataFrame functions only.

Lines are parsed into quote levels; runs of one level are passages.  Quoted passages are
hashed after normalisation, as a whole, by paragraph and by line, and looked up among what
earlier messages of the conversation said themselves: originals and quotes of one hash are
read in turn order and each quote takes the latest original before it, so no pairs are listed
however common a passage is, and one conversation's rows are cut into ranges, so none is read
by a single task.  A passage whose parts agree on a message that holds half of it or more is
linked to that message; a whole passage that the conversation does not hold is looked up among
the first sayings of the other conversations.  The links give each message its parent.
Threads are read out in pre-order: a message stands after the one it replies to and after the
whole thread below that one's earlier replies, found by ranking the tour of each thread with
pointers that double their reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import discard, in_ranges, materialize

#: Copies of a small join side over which the rows of one hash are spread.
SALTS = 16
#: Outputs of reply_order besides those of the message.
ADDED = ("n_quotes", "n_linked", "max_level", "reply_to", "origin", "thread_root", "depth", "position")

_PREFIX = r"^((?:[ \t]*>)+)"
# Ends of the lines that mail programs put before a quotation.
_ATTRIBUTION = r"(?i)(wrote|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    """Lower case, every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_lines(messages: DataFrame) -> DataFrame:
    """messages with _row and text -> (_row, line, level, body, raw): level counts the > signs
    that start a line, body is what follows them."""
    lines = messages.select("_row", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    prefix = F.regexp_extract("raw", _PREFIX, 1)
    level = F.regexp_count(prefix, F.lit(">"))
    return lines.select("_row", "line", level.alias("level"), F.regexp_replace("raw", _PREFIX + r"[ \t]?", "").alias("body"), "raw")


def _passages(lines: DataFrame) -> DataFrame:
    """(_row, passage, level, body, raw): runs of lines of one level, in order.  A line that
    announces a quotation is part of it, but not of its body."""
    order = Window.partitionBy("_row").orderBy("line")
    turned = F.when(F.col("level") != F.lag("level").over(order), 1).otherwise(0)
    marked = lines.withColumn("next", F.coalesce(F.lead("level").over(order), F.lit(0))).withColumn("turned", turned)
    marked = marked.withColumn("passage", F.sum("turned").over(order))
    intro = (F.col("level") == 0) & (F.col("next") > 0) & F.col("body").rlike(_ATTRIBUTION)
    marked = marked.select(
        "_row",
        "line",
        "raw",
        F.when(~intro, F.col("body")).alias("body"),
        F.when(intro, F.col("passage") + 1).otherwise(F.col("passage")).alias("passage"),
        F.when(intro, F.col("next")).otherwise(F.col("level")).alias("level"),
    )
    grouped = marked.groupBy("_row", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("line", "body", "raw"))).alias("l"))
    return grouped.select("_row", "passage", "level", F.array_join("l.body", "\n").alias("body"), F.array_join("l.raw", "\n").alias("raw"))


def _parts(df: DataFrame, *columns: str) -> DataFrame:
    """The body of each row as a whole (kind 0), and its paragraphs (1) and lines (2) where it
    has several: columns, kind, hash and size of those with words."""
    pieces = F.array(
        F.array(F.col("body")),
        F.split("body", r"\n\s*\n"),
        F.split("body", "\n"),
    )
    some = df.select(*columns, F.posexplode(F.transform(pieces, lambda p: F.filter(F.transform(p, normalised), lambda n: n != ""))).alias("kind", "n"))
    some = some.where((F.col("kind") == 0) | (F.size("n") > 1)).select(*columns, "kind", F.explode("n").alias("n"))
    return some.select(*columns, "kind", F.xxhash64("n").alias("hash"), F.length("n").alias("size"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _by_row(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))


def _latest_before(both: DataFrame) -> DataFrame:
    """The asking rows of both, with from_turn: the latest turn before theirs of a row with the
    same conversation, hash and size that does not ask.

    Rows lie in ranges of (conversation, hash, size, turn), so that a passage which a whole
    conversation quotes is spread over many tasks; what the ranges before hold comes from one
    row a range."""
    key, turn, asks = ["conv_id", "hash", "size"], F.col("turn").asc_nulls_first(), F.col("asks").desc()
    both = in_ranges(both, [*key, turn, asks, "_row"], "quote-both")
    said = F.when(~F.col("asks"), F.col("turn"))
    ranges = both.groupBy(*key, "_part").agg(F.max(said).alias("end"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_part").alias("_p"), F.max("end").over(before).alias("carried")).where("carried is not null")
    inside = Window.partitionBy(*key, "_part").orderBy(turn, asks).rowsBetween(Window.unboundedPreceding, -1)
    asking = both.withColumn("inside", F.last(said, ignorenulls=True).over(inside)).where("asks")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("hash") == F.col("_hash")) & (F.col("size") == F.col("_size")) & (F.col("_part") == F.col("_p"))
    return asking.join(carried, same, "left").select(*[c for c in both.columns if c != "_part"], F.coalesce("inside", "carried").alias("from_turn"))


def _numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with name: the place from 0 among the rows of one key in the given order, nulls first.
    Ranges of that order are numbered on their own and start where the ranges before end."""
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = in_ranges(df, [F.col(key).asc_nulls_first(), *by], "quote-order")
    counts = ranged.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by))
    numbered = ranged.withColumn("_inside", inside).join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return numbered.select(*df.columns, (F.col("_start") + F.col("_inside") - 1).cast("long").alias(name))


def linked_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, passages, links).  rows: _row, conv_id, turn, text, mark (a hash of the text), and
    the other columns of messages as _x0, _x1, ...; passages: (_row, passage, level, body, raw);
    links: (_row, passage, level, from_conv, from_turn) of every quoted passage with words, the
    latter null if unknown."""
    others = [c for c in messages.columns if c not in (conv, turn, text)]
    plain = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(others)])
    rows = materialize(plain.withColumns({"_row": F.monotonically_increasing_id(), "mark": F.coalesce(F.md5("text"), F.lit(""))}), "quote-rows")
    passages = materialize(_passages(quote_lines(rows.select("_row", "text"))), "quote-passages")
    at = rows.select("_row", "conv_id", "turn")

    quotes = _parts(passages.where("level > 0"), "_row", "passage", "level")
    quotes = materialize(quotes.join(at, "_row"), "quote-parts")
    own = passages.where("level = 0")
    whole = own.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("passage", "body")))["body"], "\n").alias("body"))
    said = _parts(whole, "_row").union(_parts(own, "_row")).select("_row", "hash", "size").distinct()
    # only hashes that somebody quotes go on; a line that very many say is spread over the salts
    asked = _salted(quotes.select("hash", "size").distinct())
    said = _by_row(said).join(asked, ["hash", "size", "_salt"], "left_semi").drop("_salt").join(at, "_row")
    said = materialize(said, "quote-said")
    places = said.select("hash", "size", "conv_id", "turn").distinct()

    both = quotes.withColumn("asks", F.lit(True)).unionByName(places.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    near = materialize(_latest_before(both), "quote-near")
    passage = ["_row", "passage", "kind"]
    votes = near.where("from_turn is not null").groupBy(*passage, "level", "conv_id", "from_turn").agg(F.sum("size").alias("n"))
    votes = votes.groupBy(*passage, "level", "conv_id").agg(F.array_distinct(F.array(F.max_by("from_turn", F.struct("n", "from_turn")), F.min("from_turn"))).alias("t"))
    votes = votes.select(*passage, "level", F.col("conv_id").alias("_c"), F.explode("t").alias("_t"))
    # how much of the passage the message voted for holds
    held = near.join(votes.drop("level"), passage).join(places.select(F.col("hash").alias("_h"), F.col("size").alias("_s"), F.col("conv_id").alias("_cc"), F.col("turn").alias("_tt")), (F.col("hash") == F.col("_h")) & (F.col("size") == F.col("_s")) & F.col("_c").eqNullSafe(F.col("_cc")) & (F.col("_t") == F.col("_tt")))
    held = held.groupBy(*passage, "_t").agg(F.sum("size").alias("n"))
    total = near.groupBy(*passage).agg(F.sum("size").alias("all"))
    held = held.join(total, passage).where(2 * F.col("n") >= F.col("all"))
    best = held.groupBy("_row", "passage").agg(F.max_by("_t", F.struct((-F.col("kind")).alias("k"), "n", "_t")).alias("near_turn"))

    by_conv = said.groupBy("hash", "size", "conv_id").agg(F.min("turn").alias("turn"))
    first = by_conv.groupBy("hash", "size").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    other = by_conv.join(first, ["hash", "size"]).where(~F.col("conv_id").eqNullSafe(F.col("first.conv_id"))).groupBy("hash", "size").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    firsts = _salted(first.join(other, ["hash", "size"], "left"))
    far = _by_row(near.where("kind = 0").drop("from_turn")).join(firsts, ["hash", "size", "_salt"], "left").join(best, ["_row", "passage"], "left")
    far = far.withColumn("far", F.when(~F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("first")).otherwise(F.col("second")))
    here = F.col("near_turn").isNotNull()
    links = far.select(
        "_row",
        "passage",
        "level",
        F.when(here, F.col("conv_id")).otherwise(F.col("far.conv_id")).alias("from_conv"),
        F.when(here, F.col("near_turn")).otherwise(F.col("far.turn")).alias("from_turn"),
        here.alias("here"),
    )
    return rows, passages, materialize(links, "quote-links")


def _ahead(t: DataFrame, *columns: str) -> DataFrame:
    """t: (e, to, ...) with what the row that to points at holds in columns, as _e, _to, ..."""
    other = t.select(F.col("e").alias("_e"), *[F.col(c).alias(f"_{c}") for c in columns])
    # pointers that have ended meet nothing, each on its own
    return t.join(other, F.coalesce("to", -1 - F.col("e")) == F.col("_e"), "left")


def _doubled(t: DataFrame, tag: str) -> DataFrame:
    """t: (e, to, n) -> (e, n): n summed along the pointers to, whose ends are null or not in t.
    Every round doubles a pointer's reach."""
    written = None
    while True:
        met = F.col("_e").isNotNull()
        step = _ahead(t, "to", "n").select("e", F.when(met, F.col("_to")).alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), met.alias("met"))
        before, written = written, materialize(step, tag)
        if before is not None:
            discard(before)
        t = written.select("e", "to", "n")
        if written.where("met").isEmpty():
            return t.select("e", "n")


def _threads(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(_row, root, depth, rank) of the rows of threads of two messages or more.  parents:
    (_row, parent, turn, mark); rank is the place from 0 in the thread's pre-order."""
    up = materialize(parents.select(F.col("_row").alias("e"), F.col("parent").alias("to"), F.lit(1).cast("long").alias("n")), "quote-parents")
    if up.isEmpty():
        return parents.select("_row", F.lit(0).cast("long").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("rank")).limit(0)
    depth = _doubled(up, "quote-depths")
    heads = up.select(F.col("to").alias("_row")).join(up.select(F.col("e").alias("_row")), "_row", "left_anti").distinct()
    children = materialize(_numbered(parents.select("_row", "parent", "turn", "mark"), "parent", ["turn", "mark", "_row"], "at"), "quote-children")
    nodes = children.select("_row", "parent", "at").unionByName(heads, allowMissingColumns=True)
    firsts = children.where("at = 0").select(F.col("parent").alias("_p"), F.col("_row").alias("_first"))
    nexts = children.select(F.col("parent").alias("_q"), (F.col("at") - 1).alias("_before"), F.col("_row").alias("_next"))
    nodes = nodes.join(firsts, F.col("_row") == F.col("_p"), "left").join(nexts, (F.col("parent") == F.col("_q")) & (F.col("at") == F.col("_before")), "left")
    # the tour enters (2 row) and leaves (2 row + 1) each message; messages entered are counted
    enter = F.struct((F.col("_row") * 2).alias("e"), F.coalesce(F.col("_first") * 2, F.col("_row") * 2 + 1).alias("to"), F.lit(1).cast("long").alias("n"))
    leave = F.struct((F.col("_row") * 2 + 1).alias("e"), F.coalesce(F.col("_next") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("n"))
    tour = materialize(nodes.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*"), "quote-tour")
    left = _doubled(tour, "quote-ranks").where("e % 2 = 0").select((F.col("e") / 2).cast("long").alias("_row"), F.col("n").alias("left"))
    left = materialize(left, "quote-left")
    # the head that a message's pointers end at is found the same way, by doubling to the last
    tops = _tops(up)
    sizes = left.join(heads, "_row").select(F.col("_row").alias("root"), F.col("left").alias("all"))
    found = left.join(tops, "_row", "left").join(depth.select(F.col("e").alias("_row"), F.col("n").alias("depth")), "_row", "left")
    found = found.select("_row", F.coalesce("top", "_row").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), "left").join(sizes, "root")
    return found.select("_row", "root", "depth", (F.col("all") - F.col("left")).alias("rank"))


def _tops(up: DataFrame) -> DataFrame:
    """(_row, top): where the pointers of up end."""
    t, written = up.select("e", "to"), None
    while True:
        step = _ahead(t, "to").select("e", F.coalesce("_to", "to").alias("to"), F.col("_e").isNotNull().alias("met"))
        before, written = written, materialize(step, "quote-tops")
        if before is not None:
            discard(before)
        t = written.select("e", "to")
        if written.where("met").isEmpty():
            return t.select(F.col("e").alias("_row"), F.col("to").alias("top"))


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Per message: conv_id, turn, its other columns, text without linked quotations, n_quotes,
    n_linked, max_level, reply_to (turn of the message it quotes at the first level, the latest;
    null if none), origin (struct of conv_id and turn, for quotations first said in another
    conversation), thread_root (turn of the first message of its thread) and depth in it, and
    position in the conversation's reply order from 0.

    A message stands after the one it replies to, with the whole thread below it before that
    one's next reply; threads and replies keep their turns.  A quotation that nothing is known
    of stays in the text.  A null text has no lines and gives an empty text; messages without a
    conversation share the null one; a message without a turn stands first and links nothing
    there; repeated rows stay, replies go to the first of them by text hash.  Texts of any
    length are split into lines in one row's task.  Other columns named like an output are
    called message_ and that name."""
    others = [c for c in messages.columns if c not in (conv, turn, text)]
    taken = {"conv_id", "turn", "text", *ADDED}
    rows, passages, links = linked_quotes(messages, conv, turn, text)
    kept = passages.join(links.select("_row", "passage", F.col("from_turn").isNotNull().alias("known")), ["_row", "passage"], "left")
    piece = F.when(F.col("level") == 0, F.col("body")).when(~F.col("known"), F.col("raw"))
    clean = kept.withColumn("piece", piece).where("piece is not null").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("passage", "piece"))).alias("p"))
    clean = clean.select("_row", F.regexp_replace(F.array_join("p.piece", "\n"), r"^\s+|\s+$", "").alias("clean"))
    found = links.groupBy("_row").agg(
        F.count("*").alias("n_quotes"),
        F.count("from_turn").alias("n_linked"),
        F.max("level").alias("max_level"),
        F.max(F.when(F.col("here") & (F.col("level") == 1), F.col("from_turn"))).alias("reply_to"),
        F.min(F.when(~F.col("here") & F.col("from_turn").isNotNull(), F.struct(F.col("from_conv").alias("conv_id"), F.col("from_turn").alias("turn")))).alias("origin"),
    )
    found = materialize(found, "quote-found")
    replies = found.where("reply_to is not null").select("_row", "reply_to").join(rows.select("_row", "conv_id", "turn", "mark"), "_row")
    heads = rows.groupBy("conv_id", "turn").agg(F.min_by("_row", F.struct("mark", "_row")).alias("parent")).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "parent")
    parents = replies.join(heads, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("reply_to") == F.col("_t"))).select("_row", "parent", "turn", "mark")
    threads = _threads(rows, parents)
    roots = rows.select(F.col("_row").alias("root"), F.col("turn").alias("thread_root"), F.col("mark").alias("root_mark"))
    at = rows.select("_row", "conv_id").join(threads, "_row", "left").select("_row", "conv_id", F.coalesce("root", "_row").alias("root"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("rank", F.lit(0)).alias("rank")).join(roots, "root")
    place = _numbered(at, "conv_id", ["thread_root", "root_mark", "root", "rank"], "position").select("_row", "thread_root", "depth", "position")
    full = rows.join(clean, "_row", "left").join(found, "_row", "left").join(place, "_row")
    return full.select(
        "conv_id",
        "turn",
        *[F.col(f"_x{i}").alias(f"message_{c}" if c in taken else c) for i, c in enumerate(others)],
        F.coalesce("clean", F.lit("")).alias("text"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).cast("int").alias("max_level"),
        "reply_to",
        "origin",
        "thread_root",
        "depth",
        "position",
    )
