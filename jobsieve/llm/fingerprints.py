"""Fingerprints of documents: invertible Bloom lookup sketches of their paragraph digests.

A line is cut into paragraphs of at most PARAGRAPH characters, and each distinct paragraph
into a 60-bit digest.  A digest goes into three cells of a sketch; a cell holds the number of
its digests, their exclusive or, and that of their check sums.  Sketches subtract cell by cell,
and a cell left with one digest gives it away, which frees others: peeling recovers exactly the
digests in which two versions differ.  Digests are first dealt into parts of about PART, each with a
sketch of its own.  A part that cannot be peeled is sketched again, four times larger.

A document meets the next one through ranges of ids: the texts move once, and a range's last
document takes its neighbour from the short table of the ranges' first ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobsieve.llm.common import identified

PARAGRAPH = 100  # characters of a paragraph at most
PART = 16  # digests of two versions in one sketch, about
MOST_PARTS = 256  # of a text; longer ones have larger sketches
BASE = 16  # cells for each of the three places in the fingerprint's sketch
SIZES = (8, 32, 128, 1024)  # cells for each of the three places, tried in turn
ROWS_PER_RANGE = 2_000
MOST_RANGES = 8_192

_CHECK = "({0} % 2147483629) * 69621 % 2147483647"


def paragraph_digests(text: Column) -> Column:
    """The distinct 60-bit digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{PARAGRAPH}}})"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long")))


def _place(digest: str, cells: int, which: int) -> str:
    return f"{which * cells} + cast(shiftright({digest}, {20 * which}) & {cells - 1} as int)"


def _with_places(items: str, digest: str, fields: str, cells: int) -> str:
    """Items as structs with their fields and three places p0, p1, p2."""
    places = ", ".join(f"{_place(digest, cells, k)} as p{k}" for k in range(3))
    return f"transform({items}, x -> struct({fields}, {places}))"


def sketch_cells(digests: str, cells: int = BASE) -> Column:
    """The cells of a sketch, each (n, k, s): how many digests, their exclusive or, and that of their check sums.

    The digests are bound to ``ds`` first, or Catalyst might compute them again for every cell.
    """
    add = "struct(acc.n + 1 as n, acc.k ^ x.d as k, acc.s ^ x.s as s)"
    rows = [
        f"transform(sequence({k * cells}, {(k + 1) * cells - 1}), c -> aggregate(filter(ds, x -> x.p{k} = c), struct(0 as n, 0L as k, 0L as s), "
        f"(acc, x) -> {add}))"
        for k in range(3)
    ]
    items = _with_places(digests, "x", f"x as d, {_CHECK.format('x')} as s", cells)
    return F.expr(f"transform(array({items}), ds -> concat({', '.join(rows)}))[0]")


def sketch_text(cells: str) -> Column:
    """The cells as text: count:digests:checks for each in turn."""
    return F.expr(f"array_join(transform({cells}, z -> concat_ws(':', z.n, z.k, z.s)), ',')")


_LEFT = "z -> z.n != 0 or z.k != 0 or z.s != 0"


def _subtracted(left: str, right: str) -> str:
    """The cells that are left when one sketch is taken from another, with their numbers."""
    less = f"zip_with({left}, {right}, (x, y) -> struct(x.n - y.n as n, x.k ^ y.k as k, x.s ^ y.s as s))"
    return f"filter(transform({less}, (z, i) -> struct(i as c, z.n as n, z.k as k, z.s as s)), {_LEFT})"


def _sketched(items: str, cells: int) -> str:
    """The cells that are left of a larger sketch of the signed items (d, n, s) of two documents."""
    sums = [
        f"transform(array_distinct(transform(ds, x -> x.p{k})), c -> aggregate(filter(ds, x -> x.p{k} = c), struct(c as c, 0 as n, 0L as k, 0L as s), "
        f"(acc, x) -> struct(acc.c as c, acc.n + x.n as n, acc.k ^ x.d as k, acc.s ^ x.s as s)))"
        for k in range(3)
    ]
    placed = _with_places(items, "x.d", "x.d as d, x.n as n, x.s as s", cells)
    return f"filter(transform(array({placed}), ds -> concat({', '.join(sums)}))[0], {_LEFT})"


def _peeled(begin: str, cells: int) -> str:
    """How many digests peeling recovers from the cells of a difference; null if it gets stuck."""
    places = ", ".join(_place("z.k", cells, k) for k in range(3))
    single = f"abs(z.n) = 1 and z.s = {_CHECK.format('z.k')}"
    singles = f"array_distinct(transform(filter({{0}}, z -> {single}), z -> struct(z.n as n, z.k as k, z.s as s, array({places}) as ps)))"
    without = (
        f"filter(transform(st.cells, z -> aggregate(filter(st.singles, p -> array_contains(p.ps, z.c)), z, "
        f"(w, p) -> struct(w.c as c, w.n - p.n as n, w.k ^ p.k as k, w.s ^ p.s as s))), {_LEFT})"
    )
    state = "transform(array({0}), cs -> struct(cs as cells, " + singles.format("cs") + " as singles, cast({1} as int) as found))[0]"
    step = f"if(size(st.singles) = 0, st, {state.format(without, 'st.found + size(st.singles)')})"
    return (
        f"aggregate(sequence(1, 40), {state.format(begin, '0')}, (st, r) -> {step}, "
        f"st -> if(size(st.cells) = 0, st.found, cast(null as int)))"
    )


def _ranges(docs: DataFrame) -> list[int]:
    """Ids that cut the documents into ranges of about ROWS_PER_RANGE."""
    rows = docs.count()
    ranges = min(MOST_RANGES, rows // ROWS_PER_RANGE + 1)
    if ranges == 1:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted(set(cuts))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each document with the next by ascending id; the first follows the last."""
    cuts = _ranges(docs)
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    number = F.lit(0)
    if cuts:
        table = f"array({','.join(f'cast({c} as bigint)' for c in cuts)})"
        number = F.expr(
            f"aggregate(array({','.join(map(str, steps))}), 0, (at, step) -> if(at + step <= {len(cuts)} and "
            f"element_at({table}, least(at + step, {len(cuts)})) <= doc_id, at + step, at))"
        )
    ranged = docs.withColumn("range", number)
    order = Window.partitionBy("range").orderBy("doc_id", F.xxhash64("text"))
    placed = ranged.select(
        "range", "doc_id", "text", F.lead("text").over(order).alias("following"),
    )
    lowest = ranged.groupBy("range").agg(F.min("doc_id").alias("low"))  # MOST_RANGES rows at most
    first = (
        docs.join(F.broadcast(lowest), F.col("doc_id") == F.col("low"))
        .groupBy("range").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    turn = Window.orderBy("range")  # over one document of each range
    after = first.select(
        F.col("range").alias("of"),
        F.coalesce(F.lead("text").over(turn), F.first("text").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"),
    )
    return placed.join(after, (F.col("range") == F.col("of")) & F.col("following").isNull(), "left").select(
        "doc_id", "text", F.coalesce("following", "beyond").alias("next_text")
    )


def _likeness(left: str, right: str, cells: tuple[str, str]) -> Column:
    signed = [f"transform({side}, d -> struct(d as d, {sign} as n, {_CHECK.format('d')} as s))" for side, sign in ((left, 1), (right, -1))]
    # the last way holds for digests that share all three places in every size
    exact = "size(filter(own, x -> not exists(own, y -> y.d = x.d and y.n != x.n)))"
    found = f"coalesce({', '.join(_peeled(_sketched('own', m), m) for m in SIZES)}, {exact})"
    parts = f"cast(greatest(1, least({MOST_PARTS}, ceil(size(its) / {PART}))) as int)"
    each = f"transform(array(filter(its, x -> pmod(x.d div 1009, {parts}) = part)), own -> {found})[0]"
    larger = f"aggregate(transform(sequence(0, {parts} - 1), part -> {each}), 0, (sum, n) -> sum + n)"
    total = f"coalesce({_peeled(_subtracted(*cells), BASE)}, transform(array(concat({', '.join(signed)})), its -> {larger})[0])"
    both = f"(size({left}) + size({right}))"
    return F.expr(f"if({both} = 0, 1.0D, 1 - {total} / {both})")


def likeness(rows: DataFrame, keys: list[str], versions: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name in ``versions`` the likeness of two fingerprints: 1 - |difference| / (|a| + |b|); 1 if both are empty.

    A version names two columns of digests; their base sketches are in the columns of that name with _cells.  These
    are subtracted and peeled.  Where that gets stuck, both documents are sketched again, larger.
    """
    return rows.select(*keys, *[_likeness(a, b, (f"{a}_cells", f"{b}_cells")).alias(n) for n, (a, b) in versions.items()])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row that has an id.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or all)
    of the next document's, by ascending id.  A fingerprint is the base sketch as text, all its cells, see `sketch_text`; likeness
    is the share of digests that peeling the difference of two sketches does not find to differ.

    Rows without id are left out.  A null text is empty; two empty texts have likeness 1.  Rows that
    repeat an id follow each other.  A single document is its own next one.  Extra columns are ignored.
    An empty table gives no rows.
    """
    paired = with_next(identified(docs))
    edited = F.expr("concat(substring(text, 1, n - n div 2), substring(next_text, 1, n div 2))")
    texts = paired.withColumn("n", F.char_length("text")).withColumn("edited", edited).select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("edited")).alias("cut"),
        paragraph_digests(F.col("next_text")).alias("next"),
    )
    sketched = texts.select("*", *[sketch_cells(name).alias(f"{name}_cells") for name in ("own", "cut", "next")])
    marked = sketched.select("*", sketch_text("own_cells").alias("fingerprint"), sketch_text("cut_cells").alias("edited_fingerprint"))
    keys = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    return likeness(marked, keys, {"near_edited": ("own", "cut"), "near_next": ("own", "next")})
