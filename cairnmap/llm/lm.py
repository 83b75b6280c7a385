"""Language-model scoring by a weighted backoff automaton over n-gram counts.

States are the contexts seen in training, up to ``order - 1`` words long; the arc of word w leaves state s with the smoothed
log-probability ``log10((c(s w) + mu * P(w | s')) / (c(s) + mu))`` (Dirichlet smoothing; s' is s without its first word) and
leads to the longest seen context that ends in w.  A word without an arc takes the failure arc to s', of weight
``log10(mu / (c(s) + mu))``, and is read there.  The lowest state reads every word, with ``(c(w) + 0.1) / (N + 0.1 (V + 1))``.
Probabilities of a state sum to one.  One traversal from left to right carries the state and adds up weights.

The automaton grows with the corpus and is never broadcast or collected.  Documents are cut into blocks by bytes; each block
asks the tables of counts, which are dealt into parts by n-gram hash, for the n-grams that its texts can reach, once each,
and builds and traverses the part of the automaton that comes back.  Requests carry the block's own training counts, so
counting and asking take one shuffle.  A frequent n-gram has one entry for each block of a team; past ``FAN`` blocks there
are several teams, which add up what they have and ask the next level as one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .work import Work, crc_fold, table

ORDER, MU = 3, 100.0
BLOCK_BYTES, PART_BYTES = 6 << 20, 4 << 20
#: Tokens that one lane of a traversal reads.
LANE = 512
#: Blocks that ask as a team, and teams that ask as one of the next level.
FAN = 4096
#: Tasks of a shuffle at most; with more parts or blocks a task takes several in turn.
TASKS = 1 << 16
REQUEST = "part int, block long, keys binary, counts binary"
ANSWER = "block long, part int, width int, counts binary, n long, v long"
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("width", pa.int32()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
_END, _START = np.uint64(0xE7D), np.uint64(0x57A27)


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Byte planes, compressed; sorted values as differences."""
    import zstandard

    if sorted_ and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype, sorted_: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if sorted_ else values


def ngrams(texts: pa.Array, order: int):
    """Keys of the n-grams that end at each token, by length (the lowest bit marks single tokens), and token offsets."""
    h, words = tokens.word_hashes(texts)
    n = len(words) - 1
    stream = np.insert(h, words[1:], _END)
    offs = words + np.arange(n + 1)
    place = np.arange(len(stream)) - np.repeat(offs[:-1], np.diff(offs))
    keys = [tokens.mix(stream + np.uint64(1)) | np.uint64(1)]
    run = stream
    for m in range(1, order):
        before = np.concatenate([np.full(m, _START), stream[:-m]])[: len(stream)]
        before[place < m] = _START
        run = tokens.mix(run) + before * np.uint64(0x9E3779B97F4A7C15)
        keys.append(tokens.mix(run + np.uint64(m + 1)) & ~np.uint64(1))
    return keys, offs


def _cut(block_bytes: int):
    """mapInArrow function: (doc_id, held_out, text) -> blocks of whole texts, packed.  Their numbers are drawn at random
    and hold once the table is written."""

    def run(batches):
        import zstandard

        lists = lambda values, kind: pa.array([values], pa.list_(kind))
        texts, ids, held, lengths, size = [], [], [], [], 0

        def block():
            packed = zstandard.ZstdCompressor(level=6).compress(b"".join(texts))
            offs = np.concatenate([[0], np.cumsum(lengths)])
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), lists(ids, pa.int64()), lists(held, pa.bool_()), lists(offs, pa.int64()), pa.array([packed])], names=["block", "ids", "held", "offs", "texts"])

        for whole in batches:
            for lo, hi in tokens.slices(tokens.byte_lengths(whole.column(2)), block_bytes // 8):
                data, offs = tokens.buffer_of(whole.column(2).slice(lo, hi - lo))
                if size and size + len(data) > block_bytes:
                    yield block()
                    texts, ids, held, lengths, size = [], [], [], [], 0
                texts.append(data.tobytes())
                ids += whole.column(0).slice(lo, hi - lo).to_pylist()
                held += whole.column(1).slice(lo, hi - lo).to_pylist()
                lengths += np.diff(offs).tolist()
                size += len(data)
        if ids:
            yield block()

    return run


def _grams(block: dict, order: int):
    """(distinct keys, number of the n-gram that ends at each token by length, a place of each key, token offsets)."""
    import zstandard

    offs = np.array(block["offs"], np.int64)
    data = pa.py_buffer(zstandard.ZstdDecompressor().decompress(block["texts"]))
    keys, places = ngrams(pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs), data), order)
    flat = np.concatenate(keys)
    del keys, data
    by_key = np.argsort(flat)
    flat = flat[by_key]
    new = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    numbers = np.empty(len(flat), np.int32)
    numbers[by_key] = np.cumsum(new, dtype=np.int32) - 1
    return flat[new], numbers.reshape(order, -1), by_key[new], places


def _learned(block: dict, numbers: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """How often each key occurs in the texts of the block that are learned from."""
    learn = np.repeat(~np.array(block["held"], bool), np.diff(offs))
    return np.bincount(numbers[:, learn].ravel(), minlength=size)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _request(order: int, parts: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                distinct, numbers, _, offs = _grams(block, order)
                counts = _learned(block, numbers, offs, len(distinct)).astype(np.uint32)
                cuts = np.searchsorted(_part_of(distinct, parts), np.arange(parts + 1))
                rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block["block"]] * len(rows), pa.int64()), pa.array([pack(distinct[a:b], True) for _, a, b in rows], pa.binary()), pa.array([pack(counts[a:b]) for _, a, b in rows], pa.binary())], names=["part", "block", "keys", "counts"])

    return run


def _joint(asked: pa.Table, dtype):
    """Requests for one part -> own counts and places of the keys of each, all distinct keys in order, their summed counts."""
    keys = [unpack(x, np.uint64, True) for x in asked.column("keys").to_pylist()]
    counts = [unpack(x, dtype) for x in asked.column("counts").to_pylist()]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.uint64)
    ends = np.cumsum([0] + [len(k) for k in keys])
    return counts, [inverse[a:b] for a, b in zip(ends[:-1], ends[1:])], distinct, total


def _reply(asked: pa.Table, counts: list, places: list, total: np.ndarray) -> pa.Table:
    """To each block the counts of what it asked for, without its own (so what one block alone has is 0 and packs well)."""
    wide = 4 if total.max(initial=0) < 1 << 32 else 8
    back = [pack((total[at] - own).astype(np.uint32 if wide == 4 else np.uint64)) for own, at in zip(counts, places)]
    none = pa.array([0] * len(back), pa.int64())
    return pa.table({"block": asked.column("block"), "part": asked.column("part"), "width": pa.array([wide] * len(back), pa.int32()), "counts": pa.array(back, pa.binary()), "n": none, "v": none})


def _answer(dtype):
    """All requests for one part -> the training counts that each asked for; the part's N and V, as block -1."""

    def run(asked: pa.Table) -> pa.Table:
        counts, places, distinct, total = _joint(asked, dtype)
        single = (distinct & np.uint64(1)).astype(bool) & (total > 0)
        last = pa.table([pa.array([x], f.type) for x, f in zip((-1, asked.column("part")[0].as_py(), 0, b"", int(total[single].sum()), int(single.sum())), _ANSWER)], schema=_ANSWER)
        return pa.concat_tables([_reply(asked, counts, places, total).cast(_ANSWER), last])

    return run


def _merge(dtype, parts: int, finer: int, teams: int):
    """All requests of one team for one part -> the same as requests of the team, one for each of ``finer`` parts of it."""

    def run(asked: pa.Table) -> pa.Table:
        _, _, distinct, total = _joint(asked, dtype)
        team, part = asked.column("team")[0].as_py(), asked.column("part")[0].as_py()
        fine = np.arange(part * finer, (part + 1) * finer + 1)
        cuts = np.searchsorted(_part_of(distinct, parts * finer), fine).tolist()
        rows = [(p, a, b) for p, a, b in zip(fine.tolist(), cuts[:-1], cuts[1:]) if b > a]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([team * parts + part] * len(rows), pa.int64()), "keys": pa.array([pack(distinct[a:b], True) for _, a, b in rows], pa.binary()), "counts": pa.array([pack(total[a:b]) for _, a, b in rows], pa.binary()), "team": pa.array([team % teams] * len(rows), pa.int64())})

    return run


def _relay(dtype):
    """All requests of one team for one part, and the answers to the team -> the answers to each request."""

    def run(asked: pa.Table, upper: pa.Table) -> pa.Table:
        counts, places, distinct, total = _joint(asked, dtype)
        upper = upper.sort_by("part")
        others = np.concatenate([unpack(x, np.uint32 if w == 4 else np.uint64) for x, w in zip(upper.column("counts").to_pylist(), upper.column("width").to_pylist())]).astype(np.uint64)
        if len(others) != len(distinct):
            raise ValueError(f"a team got {len(others)} counts for {len(distinct)} n-grams")
        return _reply(asked, counts, places, total + others)

    return run


def _levels(teams: int, fan: int) -> list[int]:
    """Teams of each level, up to the one that is a single team."""
    return [teams] if teams == 1 else [teams, *_levels(-(-teams // fan), fan)]


def _answers(asked: DataFrame, work: Work, teams: list[int], parts: int, fan: int, level: int = 0) -> DataFrame:
    """Requests (part, block, keys, counts, team) -> answers.  Where there are several teams, each adds up its own requests
    and asks the level above as one, for finer parts; so no group has more than about ``fan`` requests, and none is a few
    n-grams long, however many blocks ask for a frequent one."""
    dtype = np.uint64 if level else np.uint32
    if len(teams) == 1:
        dealt = asked.repartition(TASKS, "part") if parts > TASKS else asked.repartitionById(parts, F.col("part"))
        return dealt.groupBy("part").applyInArrow(_answer(dtype), ANSWER)
    asked = work.save(asked, f"asked{level}")
    tasks, finer = min(TASKS, teams[0] * parts), min(teams[0], fan)
    merged = asked.repartition(tasks, "team", "part").groupBy("team", "part").applyInArrow(_merge(dtype, parts, finer, teams[1]), REQUEST + ", team long")
    upper = work.save(_answers(merged, work, teams[1:], parts * finer, fan, level + 1), f"upper{level}")
    own = asked.withColumn("asker", F.col("team") * parts + F.col("part")).repartition(tasks, "asker").groupBy("asker")
    back = upper.where("block >= 0").withColumnRenamed("block", "asker").repartition(tasks, "asker").groupBy("asker")
    return own.cogroup(back).applyInArrow(_relay(dtype), ANSWER).unionByName(upper.where("block = -1"))


class Automaton:
    """The states and arcs that the texts of a block can reach.

    An n-gram seen in training is an arc: its last word, read in the state of the words before.  Below ``order`` words it
    is a state, too.  Both have the number of the n-gram; ``lowest`` is the state without words, after it come the starts
    of a text as contexts of 1, 2, ... words.
    """

    def __init__(self, numbers: np.ndarray, first: np.ndarray, offs: np.ndarray, counts: np.ndarray, texts: float, n_train: int, v: int, mu: float):
        order, size = numbers.shape
        self.lowest, self.start = len(counts), len(counts) + order - 1
        length, at = np.divmod(first, max(1, size))
        opens = np.zeros(size + 1, bool)
        opens[offs] = True
        seen = np.concatenate([counts, [0.0], np.full(order - 1, texts)])
        self.weight = np.log10((counts + 0.1) / (n_train + 0.1 * (v + 1)))
        self.up = np.full(len(seen), self.lowest)
        self.up[self.lowest + 2 :] = np.arange(self.lowest + 1, self.start)
        source, self.to = np.full(len(counts), self.lowest), np.where((counts > 0) & (length < order - 1), np.arange(len(counts)), self.lowest)
        for m in range(1, order):
            mine = np.flatnonzero(length == m)
            here, lower = at[mine], numbers[m - 1, at[mine]]
            source[mine] = np.where(opens[here], self.lowest + m, numbers[m - 1, here - 1])
            self.up[mine] = lower
            self.weight[mine] = np.log10((counts[mine] + mu * 10.0 ** self.weight[lower]) / (seen[source[mine]] + mu))
            if m == order - 1:
                self.to[mine] = lower
        self.to[opens[at + 1]] = self.start  # after an end, the next text begins
        self.fail = np.log10(mu / (seen + mu))
        arcs = np.flatnonzero((counts > 0) | (length == 0))
        del seen, opens, length
        key = source[arcs] * np.int64(len(counts)) + numbers[0, at[arcs]]
        by_key = np.argsort(key)
        self.keys, self.arcs, self.order = key[by_key], arcs[by_key], order

    def traverse(self, words: np.ndarray, offs: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Weight of each text's path.  All texts advance together, word by word; long ones in lanes of ``lane`` words, which
        read the ``order - 1`` words before theirs from the lowest state on: that gives the state a longer past gives."""
        lanes = -(-np.diff(offs) // lane)
        text = np.repeat(np.arange(len(lanes)), lanes)
        own = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        warm = np.where(own > 0, self.order - 1, 0)
        at, left = offs[text] + own - warm, np.minimum(np.diff(offs)[text] - own, lane) + warm
        by_length = np.argsort(-left, kind="stable")
        at, left, warm = at[by_length], left[by_length], warm[by_length]
        state = np.where(warm > 0, self.lowest, self.start)
        if self.order == 1:
            state[:] = self.lowest
        total, vocabulary = np.zeros(len(at)), np.int64(self.lowest)
        for step in range(int(left.max(initial=0))):
            todo = np.arange(np.searchsorted(-left, -step))
            counted = step >= warm
            while len(todo):
                key = state[todo] * vocabulary + words[at[todo] + step]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                arc, reads, falls = self.arcs[place[hit]], todo[hit], todo[~hit]
                total[reads] += self.weight[arc] * counted[reads]
                state[reads] = self.to[arc]
                total[falls] += self.fail[state[falls]] * counted[falls]
                state[falls] = self.up[state[falls]]
                todo = falls
        out = np.zeros(len(lanes))
        np.add.at(out, text[by_length], total)
        return out


def _score(order: int, mu: float, n_train: int, v: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        # A block has one row; should numbers drawn at random agree, its answers would not fit.
        for block in blocks.to_pylist():
            answers = answers.sort_by("part")
            distinct, numbers, first, offs = _grams(block, order)
            counts = np.concatenate([unpack(x, np.uint32 if w == 4 else np.uint64) for x, w in zip(answers.column("counts").to_pylist(), answers.column("width").to_pylist())]).astype(np.float64)
            if len(counts) != len(distinct) or blocks.num_rows > 1:
                raise ValueError(f"block {block['block']} got {len(counts)} counts for {len(distinct)} n-grams")
            counts += _learned(block, numbers, offs, len(distinct))
            # Texts begin as often as they end.
            automaton = Automaton(numbers, first, offs, counts, counts[numbers[0, offs[1] - 1]], n_train, v, mu)
            known = np.add.reduceat((counts[numbers[0]] > 0).astype(np.int64), offs[:-1])
            base = np.add.reduceat(automaton.weight[numbers[0]], offs[:-1])
            out.append(pa.table({"doc_id": pa.array(block["ids"], pa.int64()), "held_out": pa.array(block["held"], pa.bool_()), "n_tokens": pa.array(np.diff(offs)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(known), n_train, np.int64)), "base_score": pa.array(base), "score": pa.array(automaton.traverse(numbers[0], offs))}))
        none = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in none.items()})

    return run


def lm_scores(docs: DataFrame, work: Work, order: int = ORDER, mu: float = MU, folds: int = 10, held_out: int = 0, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id long, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Learns from rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_out`` (a null id counts as empty text).
    A null, empty or blank text is one end token.  Rows that repeat count each, and equal texts get equal scores.  A very
    long text is a block by itself; memory follows its number of words.  With no training row all counts are 0 and scores
    follow from the smoothing alone; an empty table gives an empty result.  Other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(TASKS, int(8 + size // (2 * block_bytes)))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", folds) == held_out).alias("held_out"), "text")
    blocks = work.save(dealt.mapInArrow(_cut(block_bytes), "block long, ids array<long>, held array<boolean>, offs array<long>, texts binary"), "blocks")
    teams = _levels(max(1, -(-blocks.count() // fan)), fan)
    parts = int(8 + size // (teams[0] * part_bytes))
    asked = blocks.mapInArrow(_request(order, parts), REQUEST).withColumn("team", F.pmod("block", F.lit(teams[0]).cast("long")))
    answers = work.save(_answers(asked, work, teams, parts, fan), "answers", split=16 << 20)
    work.drop(*(f"{name}{level}" for name in ("asked", "upper") for level in range(len(teams) - 1)))
    n, v = answers.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = answers.where("block >= 0").select("block", "part", "width", "counts").repartition(tasks, "block").groupBy("block")
    return blocks.repartition(tasks, "block").groupBy("block").cogroup(back).applyInArrow(_score(order, mu, n, v), schema)


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability under the model of nine tenths of them."""
    return lm_scores(table(spark, sf_dir, "documents"), Work(spark, "lm"))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_backoff_lm": op4_backoff_lm}
