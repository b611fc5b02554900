"""MinHash near-dedup with SetSketch registers.

1. One pass over the texts gives each document its set's size and signature and,
   once for equal sets of a task, its registers and their band keys.  Documents
   with equal sets form a class; from here on a class is its smallest document.
2. Stars: in every bucket of equal band keys all members are paired with the
   one that shares most buckets, a copy that the others were made from rather
   than any of them.  Pairs that the joint likelihood of their registers leaves
   possible are verified on their full sets, linked classes joined to components.
3. Rest: only pairs that share a bucket and are in different components are
   still open.  In each bucket the largest component is set against the others,
   in blocks of bounded size, by their registers; what has a possible partner
   stays.  Of these the full sets are written as differences from one of them,
   and blocks are set against each other once more, now exactly; a block gives
   no more links than it joins components.  So a group of thousands of copies
   costs a star and not its square, and no link between components is left out.

Bands of ``rows`` of ``m`` registers miss a pair of similarity s with chance
(1 - s**rows) ** (m / rows): 7e-9 at 0.85 and 3e-6 at 0.8 with 5 of 160.

Defined results: null, empty and wordless texts have an empty set, are linked
with nothing and stand for themselves; a null ``doc_id`` sorts after all others;
rows with the same ``doc_id`` are one document where classes are linked, each
with its own set; repeated rows are returned as often as they stand there
(:func:`drop_near` keeps one); empty tables give empty tables; extra columns
are ignored (:func:`near_classes`) or kept (:func:`drop_near`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlens.llm._text import read
from pitchlens.llm.graph import components
from pitchlens.llm.sketch import band_keys, may_reach, registers
from pitchlens.llm.suffixes import mix
from pitchlens.llm.words import SMALL_PART, binary, parts, shingles, word_hashes
from pitchlens.session import materialize

LAST_ID = 2**63 - 1
SKETCHES = "doc long, tk long, n long, s1 long, s2 long, regs binary"
CLASSES = "node long, node_tk long, n long, s1 long, s2 long, regs binary"
#: Members of a bucket that are set against each other at once.
BLOCK = 512
#: Pairs whose registers are compared at once.
PAIRS = 1 << 15


def sets_of(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    for _, some in parts(texts, SMALL_PART):
        hashes, count = word_hashes(some)
        for own in np.split(hashes, np.cumsum(count)[:-1]):
            yield shingles(own, size)


def signature(own: np.ndarray) -> tuple[int, int]:
    one, two = mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def sketches(size: int, m: int):
    """Arrow batches of (doc, tk, text) to SKETCHES; registers only with the first of equal sets in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, seen = [], set()
            for doc, tk, own in zip(b["doc"].to_pylist(), b["tk"].to_pylist(), sets_of(binary(b["text"]), size), strict=True):
                key = signature(own)
                if len(own) and key not in seen:
                    seen.add(key)
                    out.append((doc, tk, len(own), *key, registers(own, m).astype("<u2").tobytes()))
                else:
                    out.append((doc, tk, len(own), *key, None))
            if out:
                kinds = [*[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["doc", "tk", "n", "s1", "s2", "regs"])

    return run


def with_bands(rows: int):
    """Arrow batches of CLASSES with the band keys of their registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = [band_keys(np.frombuffer(r, "<u2"), rows) for r in b["regs"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bands, pa.list_(pa.int64()))], names=[*b.schema.names, "bands"])

    return run


def _rows(regs: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<u2") for r in regs.to_pylist()])


def possible(least: float):
    """Arrow batches of pairs with both sketches, (a, b) of those that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ok, _ = may_reach(_rows(b["ra"]), _rows(b["rb"]), b["na"].to_numpy(), b["nb"].to_numpy(), least)
            yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], names=["a", "b"])

    return run


def full_sets(size: int):
    """Arrow batches of (node, text) to the text's whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [s.astype("<u8").tobytes() for s in sets_of(binary(b["text"]), size)]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(own, pa.binary())], names=["node", "elements"])

    return run


def linked(num: int, den: int):
    """Arrow batches of pairs with both sets: (a, b) with den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["ea"].to_pylist(), b["eb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(keep, pa.bool_())), b["b"].filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (node, head, en, eh: their sets) to each set as what it lacks of the head's and has beyond."""
    for b in batches:
        size, lacks, marks = [], [], []
        for x, h in zip(b["en"].to_pylist(), b["eh"].to_pylist(), strict=True):
            x, h = np.frombuffer(x, "<u8"), np.frombuffer(h, "<u8")
            gone = np.setdiff1d(h, x, assume_unique=True)
            size.append(len(h))
            lacks.append(len(gone))
            marks.append(np.concatenate([gone, np.setdiff1d(x, h, assume_unique=True)]).tobytes())
        yield pa.RecordBatch.from_arrays([b["node"], b["head"], pa.array(size, pa.int64()), pa.array(lacks, pa.int64()), pa.array(marks, pa.binary())],
                                         names=["node", "head", "size", "lacks", "marks"])


def open_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell's members that are in different components and not met in another cell."""
    node, comp, main, block = (t[c].to_numpy() for c in ("node", "comp", "main", "block"))
    # cells of the largest component set its members against the others; the rest set all against all
    left, right = (np.flatnonzero(main), np.flatnonzero(~main)) if main.any() else (np.arange(len(node)), np.arange(len(node)))
    wanted = comp[left][:, None] != comp[right]
    if not main.any():  # of two blocks only the pairs across: those within have a cell of their own
        wanted &= (node[left][:, None] < node[right]) if len(np.unique(block)) == 1 else (block[left][:, None] < block[right])
    i, j = np.nonzero(wanted)
    return left[i], right[j]


def with_partner(least: float, rows: int):
    """A cell's members that may be linked with one of another component; a pair counts in the first band it shares."""

    def cell(t: pa.Table) -> pa.RecordBatch:
        i, j = open_pairs(t)
        n, band, regs = t["n"].to_numpy(), t["band"].to_numpy(), _rows(t["regs"].combine_chunks())
        fits = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
        i, j, stay = i[fits], j[fits], np.zeros(len(n), bool)
        for at in range(0, len(i), PAIRS):
            x, y = i[at:at + PAIRS], j[at:at + PAIRS]
            equal = regs[x] == regs[y]
            first = equal.reshape(len(x), regs.shape[1] // rows, rows).all(-1).argmax(1) == band[y]
            x, y = x[first], y[first]
            ok, _ = may_reach(regs[x], regs[y], n[x], n[y], least)
            stay[x[ok]] = stay[y[ok]] = True
        some = pa.array(np.flatnonzero(stay))
        return pa.RecordBatch.from_arrays([t[c].combine_chunks().take(some) for c in ("key", "node")], names=["key", "node"])

    return cell


def joining(num: int, den: int):
    """Links between a cell's members, as many as join different components."""

    def cell(t: pa.Table) -> pa.RecordBatch:
        i, j = open_pairs(t)
        node, comp, size, lacks = (t[c].to_numpy() for c in ("node", "comp", "size", "lacks"))
        marks = [np.frombuffer(m, "<u8") for m in t["marks"].to_pylist()]
        total = size - lacks + np.array([len(m) for m in marks]) - lacks
        which = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        _, mark = np.unique(np.concatenate(marks), return_inverse=True)
        common = np.zeros((len(marks), len(marks)), np.int64)
        order = np.argsort(mark, kind="stable")
        step = max(1, (1 << 22) // len(marks))
        for at in range(0, int(mark.max(initial=-1)) + 1, step):  # some marks at a time: their incidence by members
            lo, hi = np.searchsorted(mark[order], [at, at + step])
            has = np.zeros((len(marks), step), np.float32)
            has[which[order[lo:hi]], mark[order[lo:hi]] - at] = 1
            common += (has @ has.T).astype(np.int64)
        both = size[i] - lacks[i] - lacks[j] + common[i, j]
        near = den * both >= num * (total[i] + total[j] - both)
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        a, b = [], []
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q:
                up[q] = p
                a.append(int(node[x]))
                b.append(int(node[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cell


def by_cell(cell):
    """Sorted Arrow batches, through ``cell`` with all rows of a cell (key, x, y) at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, x, y = t["key"].to_numpy(), t["x"].to_numpy(), t["y"].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for at, stop in zip([0, *new], [*new, len(key)], strict=True):
                if (found := cell(t.slice(at, stop - at))).num_rows:
                    yield found

        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key, x, y = t["key"].to_numpy(), t["x"].to_numpy(), t["y"].to_numpy()
            cut = int(np.flatnonzero((key == key[-1]) & (x == x[-1]) & (y == y[-1]))[0])
            if cut:
                yield from whole(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from whole(held)

    return run


class NearClasses:
    """The steps above over one table of documents; num / den is the least similarity of a link."""

    def __init__(self, documents: DataFrame, size: int = 5, num: int = 4, den: int = 5, m: int = 160, rows: int = 5):
        self.size, self.num, self.den, self.rows, self.least = size, num, den, rows, num / den
        self.docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("tk"), "text")
        self.all = materialize(self.docs.mapInArrow(sketches(size, m), SKETCHES), "sketches")
        classes = self.all.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc", "tk")).alias("first"), F.first("regs", True).alias("regs"))
        classes = classes.select(F.col("first.doc").alias("node"), F.col("first.tk").alias("node_tk"), "n", "s1", "s2", "regs")
        self.classes = materialize(classes.mapInArrow(with_bands(rows), CLASSES + ", bands array<long>"), "classes")
        self.members = self.classes.select("node", F.posexplode("bands").alias("band", "key"))
        sizes = self.members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = materialize(self.members.join(sizes, "key"), "members")
        shared = shared.join(shared.groupBy("node").agg(F.sum("size").alias("weight")), "node")
        heads = shared.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("head"))
        self.shared = materialize(shared.join(heads, "key").select("key", "band", "node", "weight", "head"), "members")
        ends = self.classes.select("node", "node_tk").join(self.shared.select("node").distinct(), "node")
        texts = ends.join(self.docs, (F.col("node") == F.col("doc")) & (F.col("node_tk") == F.col("tk")))
        self.sets = materialize(texts.select("node", "text").mapInArrow(full_sets(size), "node long, elements binary"), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose full sets are similar enough."""
        one = self.sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
        two = self.sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
        return materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "eb").mapInArrow(linked(self.num, self.den), "a long, b long"), "links")

    def stars(self) -> DataFrame:
        """Pairs of a bucket's head and another member that may be linked."""
        pairs = self.shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        own = self.classes.select("node", "n", "regs")
        one = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        two = own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        fits = F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num
        both = pairs.join(one, "a").join(two, "b").where(fits)
        return materialize(both.mapInArrow(possible(self.least), "a long, b long"), "pairs")

    def cells(self, own: DataFrame) -> DataFrame:
        """Members (key, node, comp) of buckets with several components, once for each cell: blocks that are set against each other."""
        held = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
        held = held.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("comps"))
        held = held.where("comps > 1").select(
            "key", F.col("main.comp").alias("main_comp"), F.ceil(F.col("main.size") / BLOCK).cast("int").alias("xs"), F.ceil((F.col("size") - F.col("main.size")) / BLOCK).cast("int").alias("ys"))
        own = own.join(held, "key").withColumn("main", F.col("comp") == F.col("main_comp"))
        turn = F.xxhash64("node")
        x, y = F.pmod(turn, "xs").cast("int"), F.pmod(turn, "ys").cast("int")
        cells = F.when(F.col("main"), F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda j: F.struct(x.alias("x"), j.alias("y")))).otherwise(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: F.struct(i.alias("x"), y.alias("y"))),
            F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda j: F.struct((-1 - F.least(y, j)).alias("x"), F.greatest(y, j).alias("y")))))
        own = own.withColumn("cell", F.explode(cells)).withColumn("block", F.when(F.col("main"), x).otherwise(y))
        return own.select("*", "cell.x", "cell.y").drop("cell", "main_comp", "xs", "ys")

    def rest(self, labels: DataFrame) -> DataFrame:
        """Links that join different components of pairs that share a bucket."""
        own = self.shared.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node"))
        own = materialize(own.select("key", "band", "node", "comp", "weight"), "members")
        met = own.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 2").select("key")  # of two members the star has met the pair
        order = ["key", "x", "y", "node"]
        dealt = self.cells(own.join(met, "key")).join(self.classes.select("node", "n", "regs"), "node")
        dealt = dealt.select(*order, "comp", "main", "band", "block", "n", "regs").repartition("key", "x", "y").sortWithinPartitions(*order)
        stay = materialize(dealt.mapInArrow(by_cell(with_partner(self.least, self.rows)), "key long, node long").distinct(), "open")
        own = own.join(stay, ["key", "node"])
        heads = own.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("head"))
        own = materialize(own.join(heads, "key").select("key", "node", "comp", "head"), "members")
        one = self.sets.select("node", F.col("elements").alias("en"))
        two = self.sets.select(F.col("node").alias("head"), F.col("elements").alias("eh"))
        apart = own.select("node", "head").distinct().join(one, "node").join(two, "head").select("node", "head", "en", "eh")
        apart = materialize(apart.mapInArrow(differences, "node long, head long, size long, lacks long, marks binary"), "differences")
        dealt = self.cells(own).join(apart, ["node", "head"])
        dealt = dealt.select(*order, "comp", "main", "block", "size", "lacks", "marks").repartition("key", "x", "y").sortWithinPartitions(*order)
        return materialize(dealt.mapInArrow(by_cell(joining(self.num, self.den)), "a long, b long").distinct(), "links")

    def components(self) -> DataFrame:
        """(node, component) of the classes that have links."""
        links = self.verified(self.stars())
        labels = components(links)
        more = self.rest(labels)
        return labels if more.isEmpty() else components(links.unionByName(more))

    def result(self) -> DataFrame:
        """doc, tk, n_shingles, component: a row for each row of the documents."""
        labels = self.components()
        named = self.classes.select("node", "s1", "s2", "n").join(labels, "node", "left").select(
            "s1", "s2", "n", F.coalesce("component", "node").alias("component"))
        out = self.all.select("doc", "tk", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
        return out.select("doc", "tk", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def near_classes(documents: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``documents``."""
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    out = NearClasses(documents, size, num, den).result()
    return out.select(real("doc").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def drop_near(documents: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``documents`` (all its columns), of each group of near copies only the row with the smallest id."""
    out = NearClasses(documents, size, num, den).result()
    # rows without words are in no group: they stay, one for each id and text
    firsts = out.groupBy("component", F.when(F.col("n_shingles") == 0, F.col("tk")).alias("_own")).agg(F.min(F.struct("doc", "tk")).alias("first"))
    firsts = firsts.select(F.col("first.doc").alias("_doc"), F.col("first.tk").alias("_tk"))
    docs = documents.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "_t": F.xxhash64("text")})
    kept = docs.join(firsts, (F.col("_d") == F.col("_doc")) & (F.col("_t") == F.col("_tk")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_d", "_t").orderBy(F.lit(0)))
    return kept.withColumn("_nth", nth).where("_nth = 1").select(*[documents[c] for c in documents.columns])


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"), size=3, num=85, den=100)
