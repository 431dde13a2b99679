"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

1. A document's shingle set is hashed, fingerprinted (128 bits) and signed: ``POSITIONS`` = 40 min-hashes cut to 16 bits. Documents of equal sets are one class, named by
   its least id.
2. Signatures are split in 10 chunks of 4. A pair that differs in at most ``MAX_DISTANCE`` = 19 positions has a chunk with at most one error (pigeonhole: with two in each
   there would be 20), so each class is entered under every chunk with every choice of the position that may be wrong: 40 keys, and no pair under the distance is missed.
3. Keys of over ``hot`` classes are first taken by stars: every class of such a key is compared with a few of its classes (pivots, the least by hash), and what is linked is taken for one
   component. Within a key only classes of different components still have to meet: those outside its largest component meet all others. A family of near copies, however large, is
   one component by then, so its work grows with its members.
4. Classes that share a key are compared by signature in blocks. A pair is looked at only under its first common key.
5. The full sets of all classes with a pair under the distance are made again from their texts, sent to the same blocks, and compared exactly; pairs that are linked
   already, by way of others of the block, are skipped. A block returns at most one link a member: enough for its components.
6. Components of all links.

The distance is the only bound: signatures of a pair exactly at 85 % differ in 20 or more of 40 positions with a probability of about 2e-7, of one at 95 % with less than 1e-15.

Cases: null or empty texts, and texts without words, are linked with nothing. Rows without an id are never linked nor dropped. Repeated rows, and rows that share the kept id and
text, all stay. Ties of ids: a class has the least id of its rows. Texts of any length are read whole, some 256 kB at a time. An empty table gives an empty result. Extra columns pass
through ``drop_near_duplicates``.

Scale: copies collapse by fingerprint before anything is joined (counts and minima are combined in map tasks). A key with many classes is dealt to blocks
of at most ``members`` rows each and every pair of blocks that has to meet is a unit of work, so no task holds more than two blocks. What stays quadratic is a hot key whose classes
are *not* near each other: all of them are outside its largest component and meet, as they must. Signatures take 80 bytes a class; full sets travel only for classes with a candidate. Signatures and candidates
are held on the executors' disks (a lost executor's share is made again); classes, rounds of components and the result are written, to as many files as their rows need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ROWS_A_FILE, Scratch, bounded_batches, materialise, settings, small
from .components import components
from .shingles import fingerprint, sets, signatures

POSITIONS, CHUNK, ERRORS = 40, 4, 1
CHUNKS = POSITIONS // CHUNK
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
"""Pairs that differ in so many positions or fewer share a key: they are the candidates."""

CLASSES_A_FILE = 60_000
"""Each becomes a row a key."""


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 85
    members: int = 384
    """Rows of a block, at most; fewer for large sets, so that a block's sets stay below ``block_shingles`` members on average."""
    block_shingles: int = 2_000_000
    hot: int = 1_000
    """Classes of a key that is taken by stars first."""
    pivots: int = 3
    """Of a hot key, each round."""
    rounds: int = 3
    """Of stars, at most; the last is that after which what is left to meet is at most ``enough`` times the rows of the hot keys."""
    enough: int = 4


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def signed(docs: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, fp (null for empty sets), n_shingles, sig."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), _text_key(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 2):
                own = sets(batch.column(2), s.words)
                sig = signatures(own, POSITIONS, 16).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([fingerprint(m) if len(m) else None for m in own], pa.binary()),
                        pa.array([len(m) for m in own], pa.int64()),
                        pa.array([r.tobytes() if len(m) else None for m, r in zip(own, sig, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "text_key", "fp", "n_shingles", "sig"],
                )

    return narrow.mapInArrow(run, f"doc_id {kind}, text_key string, fp binary, n_shingles long, sig binary")


def _parts(batch: pa.RecordBatch, text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of some ``most`` bytes of text; a longer text is one alone."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).fill_null(0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def _keys(sig: Column) -> Column:
    """40 keys: each chunk without one of its positions."""
    at = lambda p: F.substring(sig, 2 * p + 1, 2)
    without = lambda p: [at(k) for k in range(p - p % CHUNK, p - p % CHUNK + CHUNK) if k != p]
    return F.array(*[F.xxhash64(F.lit(p), F.concat(*without(p))) for p in range(POSITIONS)])


def _members(n: Column, s: Settings) -> Column:
    return F.greatest(F.lit(8), F.least(F.lit(s.members), (F.lit(s.block_shingles) / n).cast("int")))


def _number(label: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(label, F.lit(5)), blocks).cast("int")


def _keyed(classes: DataFrame) -> DataFrame:
    return classes.select("label", "n", F.posexplode(_keys(F.col("sig"))).alias("pos", "key"))


def _by_size(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def _blocks(keyed: DataFrame, s: Settings) -> DataFrame:
    """key, i, j (blocks compared), blk (the row's), pos (the key's place), label, comp: the classes to meet in each unit of work. keyed: without hot keys, so a key is a small group."""
    by_key = Window.partitionBy("key")
    whole = keyed.select("key", "pos", "label", F.count("*").over(by_key).alias("here"), F.min(_members(F.col("n"), s)).over(by_key).alias("members")).filter("here > 1")
    n_blocks = F.ceil(F.col("here") / F.col("members")).cast("int")
    dealt = whole.withColumn("n_blocks", n_blocks).withColumn("blk", _number(F.col("label"), F.col("n_blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    return dealt.select("key", "pos", "blk", "label", other).select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "pos", "label", F.col("label").alias("comp"))


STAR, HUB = -1, -1
"""Marks in ``j`` a unit in which all meet one class, and in ``blk`` that class."""


def _stars(hot: DataFrame, seed: int, s: Settings) -> DataFrame:
    """Units of the classes of hot keys with the pivots of their keys, where both aren't in one component. hot: key, pos, label, n, comp."""
    least = lambda k: F.min(F.struct(F.xxhash64("label", F.lit(seed + k)).alias("h"), "label", "comp"))
    pivots = hot.groupBy("key").agg(F.array_distinct(F.array(*[F.struct(least(k)["label"].alias("pivot"), least(k)["comp"].alias("pivot_comp")) for k in range(s.pivots)])).alias("p"))
    met = hot.join(_by_size(pivots), "key").select("label", "n", "comp", F.explode("p").alias("p")).select("label", "n", "comp", "p.*").filter("comp <> pivot_comp")
    pairs = met.select("pivot", "label", "n").distinct()
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("here"), F.min(_members(F.col("n"), s)).alias("members")).select("pivot", F.ceil(F.col("here") / F.col("members")).cast("int").alias("blocks"))
    sizes = _by_size(sizes)
    unit = lambda i, blk, label: [F.xxhash64("pivot", F.lit(77)).alias("key"), i.alias("i"), F.lit(STAR).alias("j"), F.lit(blk).alias("blk"), F.lit(0).alias("pos"), F.col(label).alias("label"), F.col(label).alias("comp")]
    members = pairs.join(sizes, "pivot").select(*unit(_number(F.col("label"), F.col("blocks")), 0, "label"))
    hubs = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select(*unit(F.col("i"), HUB, "pivot"))
    return members.unionAll(hubs)


def _contracted(star: DataFrame) -> DataFrame:
    """label, root of what stars linked (a: pivot, b: what is near it): the least pivot of a class, and from there the least pivot that any class of that one's star has.

    A root is always in its class's component; that classes of one component may have several roots costs work later, but loses no link.
    """
    of_class = star.groupBy("b").agg(F.min("a").alias("p")).select(F.col("b").alias("label"), "p").unionAll(star.select(F.col("a").alias("label"), F.col("a").alias("p"))).groupBy("label").agg(F.min("p").alias("p"))
    above = star.join(_by_size(of_class), F.col("b") == F.col("label")).groupBy("a").agg(F.min("p").alias("q"))
    return of_class.join(_by_size(above), F.col("p") == F.col("a"), "left").select("label", F.least("p", F.coalesce("q", "p")).alias("root"))


def _open_keys(hot: DataFrame, s: Settings) -> DataFrame:
    """key, big (its largest component), outside and inside (blocks of the classes beside and in it), copies (rows of their units): hot keys of more than one component."""
    parts = hot.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min(_members(F.col("n"), s)).alias("members"))
    keys = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("all"), F.min("members").alias("members")).filter("all > big.n")
    blocks = lambda n: F.ceil(n / F.col("members")).cast("int")
    keys = keys.select("key", F.col("big.comp").alias("big"), F.col("all"), F.col("big.n").alias("own"), blocks(F.col("all") - F.col("big.n")).alias("outside"), blocks(F.col("big.n")).alias("inside"))
    copies = F.col("own") * F.col("outside") + (F.col("all") - F.col("own")) * (F.col("outside") + F.col("inside"))
    return keys.select("key", "big", "outside", "inside", copies.alias("copies"))


def _rest(hot: DataFrame, keys: DataFrame, s: Settings) -> DataFrame:
    """Units in which classes of hot keys meet that are not in one component: blocks of those outside a key's largest component, and these with blocks of that component."""
    rows = hot.join(_by_size(keys), "key").withColumn("own", F.col("comp") == F.col("big"))
    # blocks outside are numbered first; those inside don't meet each other
    blk = F.when(F.col("own"), F.col("outside") + _number(F.col("label"), F.col("inside"))).otherwise(_number(F.col("label"), F.col("outside")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("outside") - 1).otherwise(F.col("outside") + F.col("inside") - 1))).alias("other")
    met = rows.select("key", "pos", "label", "comp", blk.alias("blk"), "outside", "inside", "own").select("key", "pos", "label", "comp", "blk", other)
    return met.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "pos", "label", "comp")


class Unit:
    """The members of two blocks (or one) that share a key, or a hub and those it meets."""

    def __init__(self, table: pa.Table, s: Settings):
        self.blk, self.n = table["blk"].to_numpy(), table["n"].to_numpy()
        self.star = table["j"][0].as_py() == STAR
        self.slot = table["pos"][0].as_py()
        self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(table.num_rows, POSITIONS)
        self.comp = table["comp"].combine_chunks().dictionary_encode().indices.to_numpy()
        self.cross = self.blk.min() != self.blk.max()
        self.percent = s.percent

    def leads(self) -> list[int]:
        """Members whose candidates are asked for."""
        return np.flatnonzero(self.blk == HUB).tolist() if self.star else range(len(self.n) - 1)

    def candidates(self, k: int) -> np.ndarray:
        """Members after k (of a star: all others) that may be linked to it, aren't in its component, and that no earlier key brings together."""
        n, later = self.n, slice(0 if self.star else k + 1, None)
        same = self.sig[later] == self.sig[k]
        ok = (POSITIONS - same.sum(1) <= MAX_DISTANCE) & (100 * np.minimum(n[later], n[k]) >= self.percent * np.maximum(n[later], n[k])) & (self.comp[later] != self.comp[k])
        if self.cross:
            ok &= self.blk[later] != self.blk[k]
        at = np.flatnonzero(ok)
        if self.star or not len(at):
            return at + later.start
        equal = same[at].reshape(-1, CHUNKS, CHUNK)
        met = equal.sum(2)
        chunk = np.argmax(met >= CHUNK - ERRORS, 1)
        row = np.arange(len(at))
        first = chunk * CHUNK + np.where(met[row, chunk] == CHUNK, 0, np.argmin(equal[row, chunk], 1))
        return k + 1 + at[first == self.slot]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Groups of rows of equal key, i and j out of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(c).to_numpy() for c in range(3))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            this = key[a], i[a], j[a]
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = this
    if held:
        yield pa.Table.from_batches(held)


UNIT = ["key", "i", "j", "blk", "pos", "label", "comp", "n", "sig"]


def _dealt(df: DataFrame, *more: str) -> DataFrame:
    """A unit's rows together, in as many partitions as their size needs."""
    return df.select(*UNIT, *more).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _with_candidates(units: DataFrame, s: Settings) -> DataFrame:
    """The rows of a unit that have a candidate in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            if table.num_rows < 2:
                continue
            unit = Unit(table, s)
            wanted = np.zeros(table.num_rows, bool)
            for k in unit.leads():
                at = unit.candidates(k)
                if len(at):
                    wanted[k] = True
                    wanted[at] = True
            if wanted.any():
                yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()

    dealt = _dealt(units)
    return dealt.mapInArrow(run, dealt.schema)


def _links(units: DataFrame, s: Settings) -> DataFrame:
    """a, b: links that join each unit's components. units: also members (bytes of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            m = table.num_rows
            if m < 2:
                continue
            unit = Unit(table, s)
            own = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
            root = unit.comp.copy()  # what is in one component is linked already
            found = []
            for k in unit.leads():
                at = unit.candidates(k)
                at = at[root[at] != root[k]]
                if not len(at):
                    continue
                every = np.concatenate([own[x] for x in at])
                hit = own[k][np.minimum(np.searchsorted(own[k], every), len(own[k]) - 1)] == every
                sizes = np.array([len(own[x]) for x in at])
                common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
                for x in at[100 * common >= s.percent * (sizes + len(own[k]) - common)]:
                    if root[x] != root[k]:
                        root[root == root[x]] = root[k]
                        found.append((k, x))
            if found:
                label = table["label"].combine_chunks()
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([label.take(pa.array(a)), label.take(pa.array(b))], ["a", "b"])

    kind = units.schema["label"].dataType.simpleString()
    return _dealt(units, "members").mapInArrow(run, f"a {kind}, b {kind}")


def _sets_of(docs: DataFrame, wanted: DataFrame, s: Settings, doc_id: str, text: str) -> DataFrame:
    """label, members of the wanted classes (fp, label), made from the documents that give them their label."""
    labels = wanted.select(F.col("label").alias("_w"))
    labels = F.broadcast(labels) if small(labels) else labels
    texts = docs.select(F.col(doc_id).alias("_d"), F.col(text).cast("string").alias("text")).join(labels, F.col("_d") == F.col("_w"), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 0):
                own = [m for m in sets(batch.column(0), s.words) if len(m)]
                yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, own), pa.binary()), pa.array([m.tobytes() for m in own], pa.binary())], ["fp", "members"])

    once = texts.mapInArrow(run, "fp binary, members binary").groupBy("fp").agg(F.first("members").alias("members"))  # a row may be there many times
    return once.join(wanted, "fp").select("label", "members")


def clusters(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row: doc_id, text_key, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    # hashes don't compress, and trying to costs more than it saves
    with bounded_batches(docs.sparkSession), settings(docs.sparkSession, {"spark.sql.inMemoryColumnarStorage.compressed": "false"}):
        rows = scratch.hold(signed(docs, s, doc_id, text))
        classes = rows.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        n = rows.count()
        classes = scratch.materialise(classes.coalesce(1 + n // CLASSES_A_FILE), "classes")

        def links(units: DataFrame) -> DataFrame:
            near = scratch.hold(_with_candidates(units.join(classes.select("label", "n", "sig"), "label"), s))
            wanted = classes.select("fp", "label").join(near.select("label").distinct(), "label", "left_semi")
            return _links(near.join(_sets_of(docs, wanted, s, doc_id, text), "label"), s)

        keyed = _keyed(classes)
        hot_keys = scratch.hold(keyed.groupBy("key").agg(F.count("*").alias("here")).filter(F.col("here") > s.hot).select("key"))
        if hot_keys.isEmpty():
            found = links(_blocks(keyed, s))
        else:
            # written, not held: plans that hold each other grow on the driver
            hot = scratch.materialise(keyed.join(_by_size(hot_keys), "key").select("key", "pos", "label", "n"), "hot")
            hot_rows = hot.count()
            files = 1 + hot_rows // ROWS_A_FILE
            hot_keys = _by_size(scratch.materialise(hot_keys.repartition(files), "hot-keys"))
            at, found = hot.withColumn("comp", F.col("label")), None
            for r in range(s.rounds):
                star = scratch.materialise(links(_stars(at, r * s.pivots, s)).repartition(files), "star")
                found = star if found is None else found.unionAll(star)
                known = scratch.materialise(_contracted(found).repartition(files), "known")
                at = hot.join(_by_size(known), "label", "left").select("key", "pos", "label", "n", F.coalesce("root", "label").alias("comp"))
                left = scratch.materialise(_open_keys(at, s).repartition(files), "open-keys")
                if (left.agg(F.sum("copies")).first()[0] or 0) <= s.enough * hot_rows:
                    break
            left = left if s.rounds else _open_keys(at, s)
            met = links(_blocks(keyed.join(hot_keys, "key", "left_anti"), s).unionByName(_rest(at, left, s)))
            found = met if found is None else found.unionAll(met)
        tree = components(found, scratch=scratch)
        component = classes.select("fp", "label").join(tree, F.col("label") == F.col("node"), "left").select("fp", F.coalesce("root", "label").alias("component"))
        component_id = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))  # the least label of a component is its least id
        out = rows.select("doc_id", "text_key", "fp", "n_shingles").join(component, "fp", "left").select("doc_id", "text_key", "n_shingles", component_id.alias("component_id"))
        out = materialise(out.coalesce(1 + n // ROWS_A_FILE), "near-duplicates")
    scratch.free()
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def drop_near_duplicates(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that another of their component stands for, with exactly their own columns."""
    gone = clusters(docs, s, doc_id, text).filter("not kept").select(F.col("doc_id").alias("_g_id"), F.col("text_key").alias("_g_key")).distinct()
    gone = F.broadcast(gone) if small(gone, BROADCAST_ROWS) else gone
    return docs.join(gone, (F.col(f"`{doc_id}`") == F.col("_g_id")) & (_text_key(F.col(f"`{text}`")) == F.col("_g_key")), "left_anti")
