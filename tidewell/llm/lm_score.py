"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Learning runs over all texts that ``held_out`` doesn't name, in three passes of Spark:

1. Word counts: every task counts its words, Spark adds the counts.
2. Training: every task trains the model on all its texts, from the same start, and Spark averages each row's
   change with the number of updates that it got in each task as weights. A task sends the changes of the rows that it
   has touched, as half floats, in slices that are shuffled by slice.
3. Scoring, over all texts.

Model: the prediction from the two words before is h = c1 * r[w1] + c2 * r[w2]. Context words are the most frequent
words, ``WORDS_PER_ROOT`` for each unit of the square root of the vocabulary, one for all others and one for the start.
Outputs are as many words, the end, and ``GROUPS`` groups of all other words (by their last letters). So both grow
with what has been counted, up to the ``HEAD`` words that are broadcast. Outputs stand in
order of frequency in about as many classes as a class has members: p(o) = p(class of o) * p(o in its class), with the scores
h.u[class] + v[class] and h.q[o] + b[o], so batched matrix products over the classes and over one class's members give
each token's exact normalisers, once for all tokens of a slice with the same words before them, and their cost grows with the
fourth root of the vocabulary. Both factors are trained by
noise-contrastive estimation, with noise from the counts of classes and from those within a class. Inside
a group, words share its probability by (count + 1/2), with 1/2 left for unknown words: probabilities add up to 1
with one unknown word in each group.

Counts reach the scoring tasks in two ways, and together they cover the whole vocabulary: the ``HEAD``
most frequent words of at most ``HEAD_BYTES`` bytes are broadcast (a bound of HEAD * HEAD_BYTES bytes, and of HEAD * DIM * 4
for their context vectors), and all others are joined by a shuffle on the word. The driver sees the head words
and one model.

Defined results: a null text is empty and has the end token only; if nothing is left to learn from, all
counts are 0 and scores are those of the smoothed start. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, id_text
from .tokens import small_batches

HEAD = 200_000
HEAD_BYTES = 64
GROUPS = 256
WORDS_PER_ROOT = 8
DIM = 24
#: Noise classes of a batch; noise words of a block of tokens of one class.
NOISE, NOISE_INSIDE, BLOCK = 32, 8, 32
BATCH = 8192
RATE = 0.02
#: Contexts whose scores over a class are in hand at once; tokens that share the scores of their contexts.
ROWS, SHARE = 2048, 1 << 16
#: Bytes of text that are trained or scored at once, and of text whose words are looked up at once.
SOME, MANY = 2_000_000, 32_000_000
#: Rows of a table that are averaged together.
SLICE = 1024
FAN_IN = 256
#: Start and other, behind the context words.
_OTHER, _START = 0, 1


def held_out(doc_id):
    """The contract's folds: crc32 of the id as text, modulo 5, is 1."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 1


def _group(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % GROUPS


def _groups(words) -> np.ndarray:
    """``_group`` of each word of an Arrow array."""
    import pyarrow as pa
    import pyarrow.compute as pc

    last = pc.binary_slice(words.cast(pa.binary()), -3).dictionary_encode()
    return np.array([_group(w) for w in last.dictionary.to_pylist()], np.int32)[last.indices.to_numpy()]


def _split(texts):
    """Words of all texts (A-Z lower-cased; parted at the six ASCII white spaces) as an Arrow array, and words in each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, lengths = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    full = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty word there
    if not full.all():
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[full], minlength=len(lengths))
        words = words.filter(pa.array(full))
    return words, lengths


def _count(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for big in batches:
        parts = []
        for batch in small_batches(big):
            values, counts = pc.value_counts(_split(batch.column(0))[0]).flatten()
            parts.append(pa.table({"word": values, "n": counts}))
        if not parts:
            continue
        for total in pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks().to_batches():
            words = total.column("word")
            yield pa.RecordBatch.from_arrays([words, total.column("n_sum"), pa.array(_groups(words))], ["word", "n", "grp"])


class Vocabulary:
    """What every task needs: head words with counts, group masses, totals."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int, ends: int, masses: np.ndarray, n_words: int, n_context: int):
        import pyarrow as pa

        self.head = pa.array(words, pa.string())
        self.counts = np.array(counts, np.float64)
        self.total, self.distinct, self.ends = total, distinct, ends
        self.n_words, self.n_context = min(n_words, len(words)), min(n_context, len(words))
        self.outputs = self.n_words + 1 + GROUPS
        groups = _groups(self.head)
        # masses: sum of (count + 1/2) of the words of each group that aren't outputs, and 1/2
        self.masses = masses + 0.5
        np.add.at(self.masses, groups[: self.n_words], -(self.counts[: self.n_words] + 0.5))
        self.masses = np.maximum(self.masses, 0.5)
        self.out_of = np.concatenate([np.arange(self.n_words), self.n_words + 1 + groups[self.n_words :]]).astype(np.int32)
        share = np.zeros(len(words))
        share[self.n_words :] = np.log((self.counts[self.n_words :] + 0.5) / self.masses[groups[self.n_words :]])
        self.share = share
        start = np.concatenate([self.counts[: self.n_words] + 0.5, [ends + 0.5], self.masses])
        self.log_start = np.log(start / start.sum())

    def find(self, words) -> np.ndarray:
        """Head index of each word (-1: none). Every call builds a table of the head words."""
        import pyarrow.compute as pc

        return pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy()

    def encode(self, words, lengths: np.ndarray, ids: np.ndarray | None = None):
        """Head index of each token (-1: none, -2: end), output, and the contexts one and two back; ids: of the words, if they are known."""
        ids = self.find(words) if ids is None else ids
        n = len(words) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        places = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        tokens = np.full(n, -2, np.int32)
        tokens[places] = ids
        out = np.full(n, self.n_words, np.int32)
        known = tokens >= 0
        out[known] = self.out_of[tokens[known]]
        lost = np.flatnonzero(ids < 0)
        out[places[lost]] = self.n_words + 1 + _groups(words.take(lost))
        context = np.where(known & (tokens < self.n_context), tokens, self.n_context + _OTHER)
        one = np.concatenate([[0], context[:-1]])
        two = np.concatenate([[0, 0], context[:-2]])[:n]
        begins = np.concatenate([[0], ends[:-1] + 1])
        one[begins] = self.n_context + _START
        two[begins] = self.n_context + _START
        second = begins + 1
        two[second[second < n]] = self.n_context + _START
        two[begins] = self.n_context + _START
        return tokens, out, one, two, lost


def _encoded(voc: Vocabulary, batches, text_col: str):
    """(batch, its words, what ``encode`` gives for them) for slices of all batches."""
    import pyarrow as pa

    for big in batches:
        for many in small_batches(big, text_col, MANY):
            some = list(small_batches(many, text_col, SOME))
            split = [_split(b.column(b.schema.get_field_index(text_col))) for b in some]
            ids = voc.find(pa.chunked_array([words for words, _ in split], pa.string()))
            ends = np.cumsum([len(words) for words, _ in split])
            for batch, (words, lengths), own in zip(some, split, np.split(ids, ends[:-1])):
                yield batch, words, lengths, voc.encode(words, lengths, own)


def _order(at: np.ndarray) -> np.ndarray:
    """The stable argsort of numbers below 2 ** 40. Numbers that hold their own places are sorted faster than places are."""
    bits = len(at).bit_length()
    return np.sort((at.astype(np.int64) << bits) | np.arange(len(at))) & ((1 << bits) - 1)


def _normaliser(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log of the sum of exp(h.w) over all rows of the weights, in blocks of contexts that a core's cache holds."""
    out = np.empty(len(h))
    for a in range(0, len(h), ROWS):
        s = weights @ h[a : a + ROWS].T
        top = s.max()
        if top > 80:  # float32 would overflow
            s -= top
        total = np.exp(s, out=s).sum(0)
        out[a : a + ROWS] = np.log(np.maximum(total, np.float32(1e-37))) + (top if top > 80 else 0)
    return out


class Model:
    """Parameters as tables of float32 rows; outputs and their rows in q stand in order of frequency.

    r: contexts; q, b: outputs within their classes; u, v: classes; c: the factors of the last word and the one before.
    """

    TABLES = {"r": "r", "q": "qb", "u": "uv", "c": "c"}

    def __init__(self, voc: Vocabulary, given: dict[str, np.ndarray] | None = None):
        order = np.argsort(-voc.log_start, kind="stable")
        self.rank = np.empty(voc.outputs, np.int64)
        self.rank[order] = np.arange(voc.outputs)
        self.size = max(1, round(voc.outputs**0.5))  # members of a class
        start = np.exp(voc.log_start[order])
        self.first = np.arange(0, voc.outputs, self.size)
        mass = np.add.reduceat(start, self.first)
        self.upto = np.cumsum(start)
        self.log_class = np.log(mass / mass.sum()).astype(np.float32)
        self.log_inside = (np.log(start) - np.log(np.repeat(mass, self.size)[: voc.outputs])).astype(np.float32)
        if given is None:
            rng = np.random.default_rng(1)
            given = {
                "r": rng.normal(0, 0.1, (voc.n_context + 2, DIM)), "q": np.zeros((voc.outputs, DIM)), "b": self.log_inside[:, None], "u": np.zeros((len(mass), DIM)), "v": self.log_class[:, None],
                "c": np.stack([np.ones(DIM), np.full(DIM, 0.5)]),
            }
        self.tables = {k: np.array(v, np.float32) for k, v in given.items()}
        self.r, self.q, self.u, self.c = (self.tables[k] for k in "rquc")
        self.b, self.v = self.tables["b"][:, 0], self.tables["v"][:, 0]
        # sums of squared gradients, and updates
        self.seen = {k: np.full(len(v), 1e-6, np.float32) for k, v in self.tables.items()}
        self.updates = {k: np.zeros(len(v), np.int64) for k, v in self.tables.items()}

    def train(self, voc: Vocabulary, out: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive updates; tokens share noise, so updates are matrix products."""
        for a in range(0, len(out), BATCH):
            w = self.rank[out[a : a + BATCH]]
            order = _order(w)
            w, x, y = w[order], one[a : a + BATCH][order], two[a : a + BATCH][order]
            rx, ry = self.r.take(x, 0), self.r.take(y, 0)
            h = self.c[0] * rx + self.c[1] * ry
            gh = self._classes(h, w // self.size, rng) + self._inside(h, w, rng)
            self._step(np.concatenate([x, y]), False, r=np.concatenate([gh * self.c[0], gh * self.c[1]]))
            self._step(np.arange(2), True, c=np.stack([np.einsum("ij,ij->j", gh, rx), np.einsum("ij,ij->j", gh, ry)]))

    def _classes(self, h: np.ndarray, k: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        upto = np.cumsum(np.exp(self.log_class))
        noise = np.minimum(np.searchsorted(upto, rng.random(NOISE) * upto[-1]), len(upto) - 1)
        shift = self.log_class + np.float32(np.log(NOISE))
        uk, un = self.u.take(k, 0), self.u[noise]
        g = _sigmoid(-(np.einsum("ij,ij->i", h, uk) + self.v[k] - shift[k]))  # toward the data
        gn = -_sigmoid(h @ un.T + (self.v[noise] - shift[noise]))  # away from the noise
        gh = g[:, None] * uk + gn @ un
        self._step(k, True, u=g[:, None] * h, v=g[:, None])
        self._step(noise, False, u=gn.T @ h, v=gn.sum(0)[:, None])
        return gh

    def _inside(self, h: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tokens in order of their outputs, in blocks of up to ``BLOCK`` of one class with noise of their own."""
        k = w // self.size
        begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.append(begins[1:], len(k))
        blocks = -(-(ends - begins) // BLOCK)
        of = np.repeat(np.arange(len(begins)), blocks)
        place = begins[of] + BLOCK * (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        at = place[:, None] + np.arange(BLOCK)
        real = at < ends[of][:, None]
        hb = h.take(np.minimum(at, len(k) - 1), 0)
        low = self.first[k[begins]][of]
        high = np.minimum(low + self.size, len(self.upto)) - 1
        below = np.where(low > 0, self.upto[low - 1], 0.0)
        drawn = below[:, None] + rng.random((len(of), NOISE_INSIDE)) * (self.upto[high] - below)[:, None]
        noise = np.clip(np.searchsorted(self.upto, drawn), low[:, None], high[:, None])
        shift = self.log_inside + np.float32(np.log(NOISE_INSIDE))
        qw, qn = self.q.take(w, 0), self.q.take(noise, 0)
        g = _sigmoid(-(np.einsum("ij,ij->i", h, qw) + self.b[w] - shift[w]))
        gn = -_sigmoid(hb @ qn.transpose(0, 2, 1) + (self.b[noise] - shift[noise])[:, None, :]) * real[:, :, None]
        gh = g[:, None] * qw + (gn @ qn)[real]
        away = (gn.transpose(0, 2, 1) @ hb).reshape(-1, DIM)
        self._step(w, True, q=g[:, None] * h, b=g[:, None])
        self._step(noise.ravel(), False, q=away, b=gn.sum(1).reshape(-1, 1))
        return gh

    def _step(self, at: np.ndarray, in_order: bool, **gradients: np.ndarray) -> None:
        """An AdaGrad step of each touched row of the named tables by its summed gradient; a row has one rate."""
        if not in_order:
            order = _order(at)
            at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        row, n = at[first], np.diff(np.append(first, len(at)))
        for name, g in gradients.items():
            total = np.add.reduceat(g if in_order else g.take(order, 0), first, axis=0)
            seen = self.seen[name]
            seen[row] += np.einsum("ij,ij->i", total, total) / total.shape[1]
            self.tables[name][row] += (RATE / np.sqrt(seen[row]))[:, None] * total
            self.updates[name][row] += n

    def slices(self, start: Model):
        """(slice key, row numbers, updates, changes) of what has been touched since ``start``; a bias goes with its row."""
        for name, parts in self.TABLES.items():
            table = np.concatenate([self.tables[p] - start.tables[p] for p in parts], axis=1).astype(np.float16)
            rows = np.flatnonzero(self.updates[name])
            for part in np.unique(rows // SLICE).tolist():
                own = rows[np.searchsorted(rows, part * SLICE) : np.searchsorted(rows, (part + 1) * SLICE)]
                yield f"{name}{part}", (own - part * SLICE).astype(np.int32), self.updates[name][own], table[own]

    def add(self, key: str, rows: np.ndarray, changes: np.ndarray) -> None:
        """Change the rows of a slice."""
        name, part = key[0], int(key[1:])
        at = 0
        for p in self.TABLES[name]:
            width = self.tables[p].shape[1]
            self.tables[p][rows + part * SLICE] += changes[:, at : at + width]
            at += width

    def log_probs(self, out: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities: of the class, and of the output in it, by matrix products over contexts.

        Tokens with the same two words before them share the sum over the classes, and those of one class also that over its members.
        """
        import pyarrow as pa

        # a last column of 1 takes the bias into the products
        u, q = np.column_stack([self.u, self.v]), np.column_stack([self.q, self.b])
        score = np.empty(len(out))
        for a in range(0, len(out), SHARE):
            pairs = pa.array(one[a : a + SHARE].astype(np.int64) * len(self.r) + two[a : a + SHARE]).dictionary_encode()
            pair, (x, y) = pairs.indices.to_numpy(), np.divmod(pairs.dictionary.to_numpy(), len(self.r))
            h = np.ones((len(x), DIM + 1), np.float32)
            h[:, :DIM] = self.c[0] * self.r.take(x, 0) + self.c[1] * self.r.take(y, 0)
            w = self.rank[out[a : a + SHARE]]
            order = _order(w // self.size * len(x) + pair)
            w, pair = w[order], pair[order]
            k = w // self.size
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (pair[1:] != pair[:-1])]))
            row, k = pair[first], k[first]
            own = h.take(row, 0)
            lp = np.einsum("ij,ij->i", own, u.take(k, 0)) - _normaliser(h, u)[row]
            begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for i, j in zip(begins, np.append(begins[1:], len(k))):
                lp[i:j] -= _normaliser(own[i:j], q[self.first[k[i]] : self.first[k[i]] + self.size])
            score[a + order] = np.repeat(lp, np.diff(np.append(first, len(w)))) + np.einsum("ij,ij->i", h.take(pair, 0), q.take(w, 0))
        return score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of scores that ``x`` holds, which is used up; far below 0 it is 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


_SLICES = "slice string, rows binary, n binary, changes binary"


def _slice_batch(found: list[tuple], grp: int | None = None):
    import pyarrow as pa

    cols = list(zip(*found))
    arrays = [pa.array(cols[0], pa.string()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cols[1:])]
    names = ["slice", "rows", "n", "changes"]
    return pa.RecordBatch.from_arrays(arrays if grp is None else [*arrays, pa.array([grp] * len(found), pa.int32())], names if grp is None else [*names, "grp"])


def _trainer(shared):
    def run(batches):
        from pyspark import TaskContext

        voc: Vocabulary = shared.value
        part = TaskContext.get().partitionId()
        model, rng = Model(voc), np.random.default_rng(part)
        for _, _, _, (_, out, one, two, _) in _encoded(voc, batches, "text"):
            order = rng.permutation(len(out))
            model.train(voc, out[order], one[order], two[order], rng)
        for key, rows, n, changes in model.slices(Model(voc)):
            yield _slice_batch([(key, rows, n, changes)], part % FAN_IN)

    return run


def _average(batches):
    """Weighted means of the rows of each slice, one slice in memory for each that the partition holds."""
    sums: dict[str, list] = {}
    for b in batches:
        for key, rows, n, raw in zip(*(c.to_pylist() for c in b.columns[:4])):
            rows, n = np.frombuffer(rows, np.int32), np.frombuffer(n, np.int64)
            changes = np.frombuffer(raw, np.float16).reshape(len(rows), -1).astype(np.float64)
            held = sums.setdefault(key, [np.zeros(SLICE, np.int64), np.zeros((SLICE, changes.shape[1]))])
            held[0][rows] += n
            held[1][rows] += n[:, None] * changes
    for key, (n, total) in sums.items():
        rows = np.flatnonzero(n).astype(np.int32)
        yield _slice_batch([(key, rows, n[rows], (total[rows] / n[rows, None]).astype(np.float16))])


_MODELS: dict[int, Model] = {}


def _scorer(voc_shared, tables_shared, key: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        voc: Vocabulary = voc_shared.value
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model(voc, tables_shared.value)
        model = _MODELS[key]
        part, row = TaskContext.get().partitionId(), 0
        log_n = np.log(voc.total + 0.5 * (voc.distinct + 1))
        head_base = np.log(voc.counts + 0.5)
        log_mass = np.log(voc.masses)
        for batch, words, lengths, (tokens, out, one, two, lost) in _encoded(voc, batches, "text"):
            model_lp = model.log_probs(out, one, two)
            known = tokens >= 0
            base = np.zeros(len(tokens))
            base[known] = head_base[tokens[known]]
            base[tokens == -2] = np.log(voc.ends + 0.5)
            model_lp[known] += voc.share[tokens[known]]
            gone = tokens == -1
            model_lp[gone] -= log_mass[out[gone] - voc.n_words - 1]
            starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            add = lambda v: np.add.reduceat(v, starts)
            doc_of_word = np.repeat(np.arange(len(lengths)), lengths)
            tail_ends = np.cumsum(np.bincount(doc_of_word[lost], minlength=len(lengths)))
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], tail_ends]), pa.int32()), words.take(lost))
            n = lengths + 1
            n_known = add(known.astype(np.int64)) + (1 if voc.ends else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 40) + row + np.arange(len(n))), batch.column(0), pa.array(n), pa.array(n_known), pa.array(add(base) - n * log_n), pa.array(add(model_lp)), tails],
                ["row", "doc_id", "n_tokens", "n_known", "base", "model", "tail"],
            )
            row += len(n)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int | None = None, n_context: int | None = None, fold=held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores as log10.

    n_words, n_context: output and context words; by default they follow the number of words counted.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    learn = rows.where(~fold(F.col("doc_id"))).select("text")
    counts = Stored(learn.mapInArrow(_count, "word string, n long, grp int").groupBy("word").agg(F.sum("n").alias("n"), F.first("grp").alias("grp")), "lm-counts", 4).df
    ends = learn.count()
    head = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n").toArrow()
    by_group = counts.groupBy("grp").agg(F.sum(F.col("n") + 0.5).alias("mass"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()  # GROUPS rows
    masses = np.zeros(GROUPS)
    for r in by_group:
        masses[r["grp"]] = r["mass"]
    total, distinct = sum(r["n"] for r in by_group) + ends, sum(r["words"] for r in by_group) + (1 if ends else 0)
    head_words, head_counts = head.column(0).to_pylist(), head.column(1).to_pylist()
    grown = int(WORDS_PER_ROOT * distinct**0.5)
    n_words, n_context = grown if n_words is None else n_words, grown if n_context is None else n_context
    voc = Vocabulary(head_words, head_counts, total, distinct, ends, masses, n_words, n_context)
    shared = spark.sparkContext.broadcast(voc)
    # averaged in two steps, so no task reads the slices of all tasks
    trained = learn.mapInArrow(_trainer(shared), f"{_SLICES}, grp int")
    some = trained.repartition("slice", "grp").mapInArrow(_average, _SLICES)
    model = Model(voc)
    for key, rows_, _, raw in some.repartition("slice").mapInArrow(_average, _SLICES).collect():  # one model
        at = np.frombuffer(rows_, np.int32)
        model.add(key, at, np.frombuffer(raw, np.float16).reshape(len(at), -1))
    tables = spark.sparkContext.broadcast(model.tables)
    key = zlib.crc32(model.r.tobytes()) ^ total
    scored = Stored(rows.mapInArrow(_scorer(shared, tables, key), "row long, doc_id long, n_tokens long, n_known long, base double, model double, tail array<string>"), "lm-scored").df
    # what the head doesn't have: counts by a shuffle on the word
    tail = scored.select("row", F.explode("tail").alias("word")).groupBy("word", "row").agg(F.count(F.lit(1)).alias("tf"))
    found = tail.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_counts"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known")
    )
    log10 = float(np.log(10))
    out = scored.drop("tail").join(found, "row", "left")
    log_counts = F.coalesce("log_counts", F.lit(0.0))
    return out.select(
        "doc_id", fold(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        ((F.col("base") + log_counts) / log10).alias("base_score"), ((F.col("model") + log_counts) / log10).alias("score"),
    )
