"""Label and value pairs of any page without a registry: captions by shape, pairs by geometry, one value for one label.

items: doc_id, page, node_id, text, confidence, x1, y1, x2, y2, region_id, and optionally angle (degrees of a line's tilt).
Texts are judged by column expressions; admission and pairing share one shuffle by page. Arrow batches are cut at pages; pages of
like length are one array of lines, compared together, and the labels of a long page with its lines 256 at a time. Null texts are no
lines; a line with a null in its box pairs with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestry.functions import scalars as S

# Fixed values of the pairing.
CONTACT_SCORE, INLINE_SCORE, NAME_SCORE, LEAST_SCORE = 0.95, 0.9, 0.85, 0.2
OFF_AXIS, CAPPED, HEALTHY, LABEL_PENALTY, VALUE_BONUS = 0.6, 0.3, 0.5, -0.5, 0.15
ROLES = r"(?i)\b(?:name|holder|patient|tenant|landlord|employee|student|member|respondent|insured)\b"
FOREIGN = r"[㐀-鿿Ѐ-ӿ฀-๿가-힯]"
BLOCK = 256
CELLS, GROUP = 1 << 17, 1 << 22  # label by line comparisons at once (a long page: BLOCK labels), lines squared of pages together
DATES = "|".join((S.YEAR_FIRST, S.YEAR_LAST, S.DAY_NAME, S.NAME_DAY))
FIELDS = "doc_id string, page int, canonical_label string, label string, value_type string, value string, value_id string, label_id string, score double, ord int"
PAGE = ("doc_id", "page")


def label_text(raw: Column) -> Column:
    """The Latin segment of a bilingual caption, or all of it where there is none."""
    return S.clean_text(F.when(raw.rlike("[A-Za-z]"), S.clean_label_text(raw)).otherwise(raw))


def generic_type(raw: Column) -> Column:
    """date, amount (only with a currency sign or a decimal group), id_number or text, which alone has no digit."""
    s = S.strip(raw)
    money = s.rlike(r"[$₹€£]") | s.rlike(r"\d[.,]\d")
    return (
        F.when(~F.coalesce(raw.rlike(r"\d"), F.lit(False)), "text")
        .when(S.strip(s).rlike(DATES) & S.parse_date(s)["valid"], "date")
        .when(money & S.parse_amount(s)["valid"], "amount")
        .when(s.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-/]{3,}$") & s.rlike(r"\d"), "id_number")
        .otherwise("text")
    )


def looks_like_label(raw: Column) -> Column:
    """A short phrase with letters that is no date, amount or number, or that ends in a colon."""

    return F.coalesce(S.let(label_text(raw), lambda t: label_shape(t, raw)), F.lit(False))


def label_shape(t: Column, raw: Column) -> Column:
    """looks_like_label of a raw text whose label_text is t."""
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))  # one between words: t is clean
    return F.length(t).between(2, 40) & (spaces <= 4) & t.rlike("[A-Za-z]") & ((generic_type(t) == "text") | raw.rlike(r":\s*$"))


def garbled(text: Column, confidence: Column) -> Column:
    """A read that no caption can own: other scripts, under 60 % word characters, three characters or fewer, or under 0.55 sure."""
    s = S.strip(text)
    odd = r"[^A-Za-z0-9\s.,:/#&@+'()\-]"
    wordy = F.length(F.regexp_replace(s, odd + "+", ""))
    strange = s.rlike(odd) & (s.rlike(FOREIGN) | (wordy < 0.6 * F.length(s)))
    tiny = ~s.rlike("(?:[A-Za-z0-9][^A-Za-z0-9]*){4}")
    return strange | tiny | F.coalesce(confidence < 0.55, F.lit(False))


def admission(over=None) -> Column:
    """Aggregate over a page's lines (definite, angle beside the items' columns): whether it may be a form at all.

    Three captions, or 8 % of the lines, decide for it; else lines tilted in three directions, or over 40 % garbled ones, against it."""
    total = lambda c: F.sum(c.cast("int")) if over is None else F.sum(c.cast("int")).over(over)
    n = F.count(F.lit(1)) if over is None else F.count(F.lit(1)).over(over)
    tilt = F.when(F.abs("angle") >= 2.5, F.floor(F.col("angle") / 15 + 0.5))
    headings = F.collect_set(tilt) if over is None else F.collect_set(tilt).over(over)  # at most 25 of them
    captions = total(F.col("text").rlike(r":\s*\S*\s*$") | F.col("definite"))
    scattered = (total(F.coalesce(F.abs("angle") >= 2.5, F.lit(False))) >= 4) & (F.size(headings) >= 3)
    return (captions >= 3) | (captions >= 0.08 * n) | (~scattered & (total(garbled(F.col("text"), F.col("confidence"))) <= 0.4 * n))


def lines(items: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """The lines that may pair (no zone fragments, no empty ones), with ``definite``: the registry (phrase; small and fixed) knows it."""
    angle = F.col("angle").cast("double") if "angle" in items.columns else F.lit(None).cast("double")
    box = [F.col(c).cast("double").alias(c) for c in ("confidence", "x1", "y1", "x2", "y2")]
    rows = items.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("node_id").cast("string").alias("node_id"), "text", *box, F.col("region_id").cast("string").alias("region_id"), angle.alias("angle"))
    rows = rows.filter(F.col("text").rlike(S.INK) & ~F.contains("text", F.lit("<")))
    if registry is None:
        return rows.withColumn("definite", F.lit(False))
    known = registry.select(S.normalize_label_text(F.col("phrase")).alias("phrase")).distinct().withColumn("definite", F.lit(True))
    met = rows.withColumn("phrase", S.normalize_label_text(label_text(F.col("text")))).join(F.broadcast(known), "phrase", "left")
    return met.withColumn("definite", F.coalesce("definite", F.lit(False))).drop("phrase")


def admitted_pages(items: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, admitted) of every page that has a line."""
    return lines(items, registry).groupBy(*PAGE).agg(admission().alias("admitted"))


def judged(rows: DataFrame) -> DataFrame:
    """What each line's text says by itself: the field it holds (own_*), whether it may be a label, a name, a role."""
    text, before, after = F.col("value"), F.col("before"), F.col("after")
    colon = F.contains("text", F.lit(":"))
    rows = rows.withColumns({"value": S.clean_text(F.col("text")), "label": label_text(F.col("text")), "before": F.when(colon, F.regexp_extract("text", r"(?s)^([^:]*):", 1)), "after": F.when(colon, S.clean_text(F.regexp_extract("text", r"(?s)^[^:]*:(.*)$", 1)))})
    email = F.regexp_extract(text, r"(?i)^e-?mail\s*:?\s*(\S+@\S+)$", 1)
    phone = F.regexp_extract(text, r"(?i)^(?:phone|tel(?:ephone)?|mobile)\s*:?\s*(\+?[0-9][0-9().\s\-]*[0-9])$", 1)
    rows = rows.withColumns({"email": email, "phone": phone, "before_label": F.when(after != "", label_text(before)), "capitals": text.rlike(r"^[A-Z][A-Z .'\-]*$") & F.size(F.split(text, " ")).between(2, 4)})
    email, phone, caption = F.col("email"), F.col("phone"), F.col("before_label")
    own = lambda label, kind, value, score: F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"), F.lit(score).alias("score"))
    inline = F.coalesce(label_shape(caption, before), F.lit(False))
    own = F.when(S.is_valid_email(email), own("Email", "email", email, CONTACT_SCORE)).when((phone != "") & S.is_plausible_phone(phone), own("Phone", "phone", phone, CONTACT_SCORE)).when((after != "") & inline, own(caption, generic_type(after), after, INLINE_SCORE))
    rows = rows.withColumns({"own": own, "kind": generic_type(F.col("text")), "like": F.coalesce(label_shape(F.col("label"), F.col("text")), F.lit(False)), "headline": F.col("capitals") & (F.length(text) <= 60) & text.rlike(r"[A-Z].*\s+[A-Z]")})
    rows = rows.withColumns({"role": F.col("label").rlike(ROLES), "slug": S.slug(F.col("label"), ""), "own_slug": S.slug(F.col("own.label"), "")})
    return rows.select(*PAGE, "node_id", "confidence", "x1", "y1", "x2", "y2", "region_id", "definite", "value", "kind", "label", "like", "capitals", "headline", "role", "slug", "own_slug", F.col("own.label").alias("own_label"), F.col("own.kind").alias("own_kind"), F.col("own.value").alias("own_value"), F.col("own.score").alias("own_score"))


def overlap(lo_a, hi_a, lo_b, hi_b):
    """Of intervals a (down) and b (across): what they share over the shorter of the two."""
    shared = np.minimum(hi_a[:, None], hi_b) - np.maximum(lo_a[:, None], lo_b)
    shorter = np.minimum((hi_a - lo_a)[:, None], hi_b - lo_b)
    return np.where(shorter > 0, np.maximum(shared, 0) / np.where(shorter > 0, shorter, 1), 0.0)


class Lines:
    """The geometry of pages' lines: arrays of page by place in reading order.

    Places behind a page's last line have no box, so that they meet nothing. Lines a are given by their pages p and places a."""

    def __init__(self, x1, y1, x2, y2, like):
        self.x1, self.y1, self.x2, self.y2, self.like = x1, y1, x2, y2, like
        self.pages, self.n = like.shape
        self.labels = np.nonzero(like)

    def blocks(self, p, a):
        step = max(BLOCK, CELLS // self.n)
        return ((p[k : k + step], a[k : k + step]) for k in range(0, len(p), step))

    def high(self, p, a):
        return overlap(self.y1[p, a], self.y2[p, a], self.y1[p], self.y2[p])

    def wide(self, p, a):
        return overlap(self.x1[p, a], self.x2[p, a], self.x1[p], self.x2[p])

    def others(self, a):
        return np.arange(self.n) != a[:, None]

    def under(self, p, a, depth):
        """Lines that stack under a within depth."""
        gap = self.y1[p] - self.y2[p, a][:, None]
        return (gap >= -0.01) & (gap < depth) & (self.wide(p, a) >= 0.5) & self.others(a)

    def axis(self):
        """By page: 1 where values mostly stand beside their labels, -1 where below, 0 where neither prevails."""
        votes = np.zeros(self.pages, "int64")
        for p, a in self.blocks(*self.labels):
            gap = self.x1[p] - self.x2[p, a][:, None]
            beside = (gap >= -0.01) & (gap < 0.04) & (self.high(p, a) >= 0.5) & self.others(a)
            below = self.under(p, a, 0.1) & (self.wide(p, a) >= 0.7)
            for s, m in ((1, beside), (-1, below)):
                votes += s * np.bincount(p[m.any(1) & ~self.like[p, m.argmax(1)]], minlength=self.pages)
        return np.sign(votes)

    def those(self, p, a, test):
        """The lines among a that pass a test of blocks."""
        kept = [np.zeros(0, bool), *(test(q, b) for q, b in self.blocks(p, a))]
        kept = np.concatenate(kept)
        return p[kept], a[kept]

    def columns(self):
        """(heads, cells, celled): labels over two values or more with another such label in their row, as a mask; by page that has
        some, the lines under each; the lines in any column.

        A line outside them whose row meets two columns is a cell of a column of its own."""
        over, heads, celled = (np.zeros(self.like.shape, bool) for _ in range(3))
        over[self.those(*self.labels, lambda p, a: (self.under(p, a, 0.2) & ~self.like[p]).sum(1) >= 2)] = True
        p, a = self.those(*np.nonzero(over), lambda p, a: ((self.high(p, a) >= 0.5) & self.others(a) & over[p]).any(1))
        heads[p, a] = True
        cells = {}
        for page in np.unique(p).tolist():
            mine = a[slice(*np.searchsorted(p, (page, page + 1)))]
            under = np.concatenate([self.under(*b, 0.45) for b in self.blocks(np.full(len(mine), page), mine)])
            alone = np.zeros(self.n, bool)
            for o in np.flatnonzero(~under.any(0) & ~np.isnan(self.y1[page])):
                row = (self.high(np.array([page]), np.array([o]))[0] >= 0.5) & (np.arange(self.n) != o)
                alone[o] = under[:, row].any(1).sum() + alone[row].sum() >= 2
            cells[page], celled[page] = under.astype("int32"), under.any(0) | alone
        return heads, cells, celled


def pairs_of(g: Lines, region, confidence, definite, capitals, role):
    """(page, label, value, score) of every pair above the least score, by page and falling score."""
    sure, free = np.nan_to_num(confidence), ~definite
    axis, (head, cells, celled) = g.axis(), g.columns()
    found = []
    for p, a in g.blocks(*g.labels):
        high, wide = g.high(p, a), g.wide(p, a)
        right, down = g.x1[p] - g.x2[p, a][:, None], g.y1[p] - g.y2[p, a][:, None]
        beside = (right >= -0.01) & (high >= 0.3)
        below = (down >= -0.01) & (wide >= 0.2) & (down < 0.1)
        same = (region[p] < 0) | (region[p, a] < 0)[:, None] | (region[p] == region[p, a][:, None])
        valid = (beside | below) & same & free[p] & g.others(a)
        place = np.where(beside, 1 - np.minimum(np.maximum(right, 0) * 2, 0.4), np.where(g.like[p], 0.6, 0.55 + 0.4 * wide))
        # The lowest bottom of a line between is what blocks; a line does not stand before itself, so the two lowest are enough.
        between = (g.y1[p] > g.y2[p, a][:, None] - 0.005) & (wide >= 0.5) & g.others(a)
        bottoms = np.where(between, g.y2[p], np.inf)
        first = bottoms.argmin(1)
        least, second = np.partition(bottoms, 1, axis=1)[:, :2].T
        blocked = np.where(np.arange(g.n) == first[:, None], second[:, None], least[:, None]) < g.y1[p] + 0.005
        lower = down >= -0.01
        place = np.where(lower & (head[p, a][:, None] | blocked), np.minimum(place, CAPPED), place)
        shared = np.zeros(lower.shape, bool)
        for page in cells.keys() & set(p[celled[p, a]].tolist()):
            lo, hi = np.searchsorted(p, (page, page + 1))
            shared[lo:hi] = cells[page][:, a[lo:hi]].T @ cells[page] > 0
        in_row = ~lower & celled[p, a][:, None] & celled[p] & ~shared
        off = (lower & (axis[p] > 0)[:, None]) | (~lower & (axis[p] < 0)[:, None])
        place = np.where(in_row, 1.0, np.where(off, place * OFF_AXIS, place))
        better = (valid & (place >= HEALTHY) & ~g.like[p]).any(1)
        stacked = role[p, a][:, None] & capitals[p] & g.under(p, a, 0.06) & (wide >= 0.7)
        bonus = np.where(g.like[p] & better[:, None] & ~stacked, LABEL_PENALTY, VALUE_BONUS)
        away = np.maximum(np.where(lower, down, right), 0)
        score = place * 0.5 - np.minimum(away, 0.5) * 0.7 + 0.05 * sure[p] + bonus
        k, v = np.nonzero(valid & (score > LEAST_SCORE))
        found.append((p[k], a[k], v, score[k, v]))
    page, label, value, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((value, label, -score, page))
    return page[order], label[order], value[order], score[order]


def codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where values are; -1 for null."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def flags(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(False).to_numpy()


def reading_order(rows: pa.Table, page: np.ndarray) -> np.ndarray:
    """Places of the lines by page, y1, x1 and node_id, what is missing last; doubles as they came."""
    nodes = rows["node_id"].combine_chunks().dictionary_encode()
    names = nodes.dictionary.to_pylist()
    rank = np.full(len(names) + 1, len(names))  # the last one is null's
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    node = rank[nodes.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    return np.lexsort((node, rows["x1"].to_numpy(), rows["y1"].to_numpy(), page))


def page_numbers(rows: pa.Table) -> np.ndarray:
    """The pages counted from 0 as they follow one another."""
    doc, page = (codes(rows[c].combine_chunks()) for c in PAGE)
    return np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])])


def best_pairs(column: dict, page: np.ndarray):
    """(label, value, score), as places in the columns, of the pairs of all pages: best first, each line once as label and as value."""
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    sizes = np.diff(np.r_[starts, len(page)])
    wanted = np.flatnonzero(np.logical_or.reduceat(column["like"], starts) & (sizes >= 2))
    wide = np.int64(2) ** np.ceil(np.log2(sizes[wanted])).astype("int64")
    kept = []
    for n in np.unique(wide).tolist():
        alike, together = wanted[wide == n], max(1, GROUP // n**2)
        for k in range(0, len(alike), together):
            group = alike[k : k + together]
            size = sizes[group]
            p = np.repeat(np.arange(len(group)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            line = starts[group][p] + place

            def filled(name, empty):
                out = np.full((len(group), size.max()), empty, column[name].dtype)
                out[p, place] = column[name][line]
                return out

            lines = Lines(*(filled(c, np.nan) for c in ("x1", "y1", "x2", "y2")), filled("like", False))
            taken = set()
            for q, l, v, score in zip(*(x.tolist() for x in pairs_of(lines, filled("region", -1), filled("confidence", np.nan), *(filled(c, False) for c in ("definite", "capitals", "role"))))):
                if (q, l, 0) in taken or (q, v, 1) in taken:
                    continue
                taken |= {(q, l, 0), (q, v, 1)}
                kept.append((int(starts[group[q]]) + l, int(starts[group[q]]) + v, min(max(score, 0.0), 1.0)))
    label, value, score = zip(*kept) if kept else ((), (), ())
    return np.array(label, "int64"), np.array(value, "int64"), np.array(score, "float64")


def fields_of_pages(rows: pa.Table) -> pa.RecordBatch:
    """The fields of whole pages: lines that hold their own, a headline above contacts, then pairs, best first, each line once."""
    page = page_numbers(rows)
    order = reading_order(rows, page)
    rows = rows.take(pa.array(order))
    page = page[order]
    texts = {c: rows[c].combine_chunks().cast(pa.string()) for c in ("value", "kind", "label", "slug", "own_slug", "own_label", "own_kind", "own_value")}
    y1, own_score = rows["y1"].to_numpy(), rows["own_score"].to_numpy()
    own = rows["own_label"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    contact = own_score == CONTACT_SCORE
    kinds = texts["own_kind"].to_numpy(zero_copy_only=False)
    pages = page[-1] + 1
    both = np.ones(pages, bool)
    for kind in ("email", "phone"):
        both &= np.bincount(page[contact & (kinds == kind)], minlength=pages) > 0
    highest = np.full(pages, np.nan)
    np.fmin.at(highest, page[contact], y1[contact])
    above = np.flatnonzero(~own & flags(rows["headline"]) & both[page] & (y1 < highest[page]))
    above = above[np.unique(page[above], return_index=True)[1]]
    rest = ~own
    rest[above] = False
    rest, mine = np.flatnonzero(rest), np.flatnonzero(own)
    label = value = np.zeros(0, "int64")
    score = np.zeros(0)
    if len(rest):
        column = {c: rows[c].to_numpy()[rest] for c in ("x1", "y1", "x2", "y2", "confidence")} | {c: flags(rows[c])[rest] for c in ("like", "definite", "capitals", "role")}
        label, value, score = best_pairs(column | {"region": codes(rows["region_id"].combine_chunks())[rest]}, page[rest])
        label, value = rest[label], rest[value]
    # Fields by how they were found; the texts of each from the columns of its way, one behind the other.
    label, value, score = np.r_[mine, above, label], np.r_[mine, above, value], np.r_[own_score[mine], np.full(len(above), NAME_SCORE), score]
    n, way = len(page), np.repeat([0, 1, 2], [len(mine), len(above), len(label) - len(mine) - len(above)])


    def text(name, at, constant=None):
        pool = pa.concat_arrays([texts[f"own_{name}"], texts[name], pa.array([constant], pa.string())])
        return pool.take(pa.array(np.where(way == 0, at, np.where((way == 1) & (constant is not None), 2 * n, n + at))))

    slug = text("slug", label, "full_name")
    # Of a label twice on a page the better score stays, the first found of equals; pairs come by falling score.
    key = codes(slug)
    order = np.lexsort((np.arange(len(label)), -score, key, page[label]))
    of_page, of_key = page[label][order], key[order]
    best = order[np.r_[True, (of_page[1:] != of_page[:-1]) | (of_key[1:] != of_key[:-1])][: len(order)]]
    best = best[np.lexsort((value[best], label[best]))]
    of_page = page[label[best]]
    ords = np.arange(len(best)) - np.searchsorted(of_page, of_page) + 1
    at = lambda name, places: rows[name].combine_chunks().take(pa.array(places[best]))
    chosen = [x.take(pa.array(best)) for x in (slug, text("label", label, "Full Name"), text("kind", value, "name"), text("value", value))]
    out = [at("doc_id", label), at("page", label), *chosen, at("node_id", value), at("node_id", label), pa.array(score[best]), pa.array(ords, pa.int32())]
    out = [x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in out]
    return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in FIELDS.split(", ")])


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of batches in which a page's lines follow one another; what may go on in the next batch waits for it."""
    at = lambda rows, k: tuple(rows.column(c)[k].as_py() for c in PAGE)
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if at(batch, batch.num_rows - 1) != at(held[0], 0):
            rows = pa.Table.from_batches(held)
            numbers = page_numbers(rows)
            last = int(np.searchsorted(numbers, numbers[-1]))
            yield fields_of_pages(rows.slice(0, last))
            held = rows.slice(last).to_batches()
    if held:
        yield fields_of_pages(pa.Table.from_batches(held))


def generic_fields(items: DataFrame, registry: DataFrame | None = None, claimed: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, canonical_label, label, value_type, value, value_id, label_id, score, ord) of all admitted pages.

    claimed: (doc_id, node_id) of lines that other extractors own. Of a label twice on a page the better score stays; the order of
    ties is reading order. An empty table, a page without labels and a refused page give no row."""
    if claimed is not None:
        items = items.join(claimed.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti")
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: few bytes of lines are much work
    rows = lines(items, registry).repartition(tasks, *PAGE).withColumn("admitted", admission(W.partitionBy(*PAGE))).filter("admitted")
    return judged(rows).sortWithinPartitions(*PAGE).mapInArrow(whole_pages, FIELDS)


def sparse_probe(anchors: DataFrame, reads: DataFrame, least: float = 0.85) -> DataFrame:
    """(doc_id, template_id, score, hit): the share of a template's anchors read again where it expects them.

    anchors: template_id, anchor_id, value, required (a small fixed list); reads: doc_id, template_id, anchor_id, text. An anchor is
    met by a similarity of 0.9, or inside the read from six characters on. A hit has ``least`` of them and all required ones."""
    expected = anchors.select("template_id", "anchor_id", F.lower(F.trim(F.coalesce("value", F.lit("")))).alias("want"), F.coalesce("required", F.lit(False)).alias("required"))
    probed = reads.select("doc_id", "template_id").distinct().join(F.broadcast(expected), "template_id")
    seen = reads.groupBy("doc_id", "template_id", "anchor_id").agg(F.max(F.lower(F.trim(F.coalesce("text", F.lit(""))))).alias("got"))
    longest = F.greatest(F.length("want"), F.length("got"))
    alike = 1 - F.levenshtein("want", "got") / longest >= 0.9
    met = F.coalesce((F.length("want") > 0) & (alike | ((F.length("want") >= 6) & F.contains("got", F.col("want")))), F.lit(False))
    rows = probed.join(seen, ["doc_id", "template_id", "anchor_id"], "left").withColumn("met", met)
    share = F.avg(F.col("met").cast("double"))
    return rows.groupBy("doc_id", "template_id").agg(share.alias("score"), ((share >= least) & F.bool_and(F.col("met") | ~F.col("required"))).alias("hit"))


def country_codes(values: DataFrame, names: DataFrame) -> DataFrame:
    """values (id, value) with ``code``: what all segments around '/' that name a country agree on, else null.

    names: (code, name), a small fixed table; the names may hold other forms of a country. Three-letter codes win over shorter ones."""
    key = lambda c: S.clean_text(F.regexp_replace(F.upper(S.normalize_label_text(c)), "[^A-Z0-9]+", " "))
    known = names.select(key(F.col("name")).alias("k"), "code", F.lit(1).alias("by")).unionByName(names.select(key(F.col("code")).alias("k"), "code", F.lit(0).alias("by")))
    known = known.filter("k <> ''").groupBy("k").agg(F.min_by("code", F.struct("by", -F.length("code"), "code")).alias("code"))
    parts = values.select("id", F.explode(F.split("value", "/")).alias("part")).select("id", key(F.col("part")).alias("k"))
    agreed = parts.join(F.broadcast(known), "k").groupBy("id").agg(F.min("code").alias("code"), F.max("code").alias("last"))
    return values.join(agreed.filter("code = last").drop("last"), "id", "left")
