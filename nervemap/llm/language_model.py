"""A hidden Markov language model over whole texts.

The latent states emit word classes, and a class its words: P(word | state) = P(class | state) * P(word | class). A word's class is a hash of
its ending, so the emission table is bounded; P(word | class) = (c + 1) / (N_class + V_class + 1) uses the counts
of every training word, the last 1 being for words never seen. Baum-Welch counts are summed over all partitions in each round; the
score is the exact likelihood of the text by the scaled forward recursion, end included.

Word counts never stand in one place. Texts are read once, into blocks of word numbers; the blocks of a stretch of input form a bundle.
Words are counted by a map-side combined sum; each bundle then asks for the counts of its own distinct words by a join, in which a
frequent word is one row a bundle. A word goes by 64 bits: its class, and 52 bits of a hash.
"""

from __future__ import annotations

import secrets
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nervemap.llm.hmm import Counts, HiddenMarkov
from nervemap.runtime import materialize, partitions, trimmed, trimmed_group

#: Classes of words; one more is the end of a text.
CLASSES = 4096
#: Bytes of text of a block and of a bundle of blocks.
BLOCK, BUNDLE = 1 << 20, 12 << 20
ENDING = 4


def word_class(word: bytes) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(word[-ENDING:], 7) % CLASSES


def _kind(n_words: int) -> type:
    """The type that numbers of so many words are kept in."""
    return np.uint16 if n_words <= 1 << 16 else np.uint32


def _block(bundle: int, ids: list, held: list[bool], texts: list[bytes]) -> tuple:
    from xxhash import xxh64_intdigest

    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes, tokens = [], []
    for t in texts:
        words = t.lower().split()
        sizes.append(len(words))
        tokens.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
    classes = np.fromiter(map(word_class, number), np.uint16, len(number))
    names = np.fromiter((xxh64_intdigest(w) for w in number), np.uint64, len(number)) // np.uint64(CLASSES) * np.uint64(CLASSES) + classes
    stream = np.concatenate(tokens)
    train = np.repeat(~np.array(held, dtype=bool), sizes)
    counts = np.bincount(stream[train], minlength=len(number)).astype(np.uint32)
    stream = stream.astype(_kind(len(number)))
    return bundle, ids, held, sizes, stream.tobytes(), names.tobytes(), counts.tobytes()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle, of_bundle = secrets.randbits(62), 0
    for batch in batches:
        schema = pa.schema({"bundle": pa.int64(), "ids": pa.list_(batch["id"].type), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64())} | dict.fromkeys(("tokens", "names", "counts"), pa.binary()))
        lo, size, texts = 0, 0, []
        for i, t in enumerate(batch["text"]):
            texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1]) + 1
            if size > BLOCK or len(texts) == 60_000 or i == batch.num_rows - 1:
                part = batch.slice(lo, len(texts))
                row = _block(bundle, part["id"].to_pylist(), part["held"].to_pylist(), texts)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)
                of_bundle += size
                if of_bundle > BUNDLE:
                    bundle, of_bundle = secrets.randbits(62), 0
                lo, size, texts = i + 1, 0, []


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a block: bundle, name, count."""
    for batch in batches:
        for bundle, names, counts in zip(batch["bundle"].to_pylist(), batch["names"], batch["counts"], strict=True):
            name = np.frombuffer(names.as_py(), np.int64)
            n = np.frombuffer(counts.as_py(), np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), bundle, dtype=np.int64)), pa.array(name), pa.array(n)], ["bundle", "name", "n"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each bundle, whose blocks stand one after another; a bundle that is read in parts asks twice for some."""
    last, held = None, []

    def rows() -> pa.RecordBatch:
        name = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(name), last, dtype=np.int64)), pa.array(name)], ["bundle", "name"])

    for batch in batches:
        for bundle, names in zip(batch["bundle"].to_pylist(), batch["names"], strict=True):
            if bundle != last and held:
                yield rows()
                held = []
            last = bundle
            held.append(np.frombuffer(names.as_py(), np.int64))
    if held:
        yield rows()


def _classes(names: bytes) -> np.ndarray:
    return np.frombuffer(names, np.int64) & (CLASSES - 1)


def _sequences(r: dict, only_training: bool) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a block's texts, each followed by the end, and their lengths."""
    sizes = np.array(r["sizes"], dtype=np.int64)
    classes = _classes(r["names"])
    symbols = classes[np.frombuffer(r["tokens"], _kind(len(classes)))] if r["tokens"] else np.zeros(0, np.int64)
    symbols = np.insert(symbols, np.cumsum(sizes), CLASSES)
    sizes = sizes + 1
    if only_training:
        train = ~np.array(r["held"], dtype=bool)
        symbols, sizes = symbols[np.repeat(train, sizes)], sizes[train]
    return symbols, sizes


def _expectations(model: HiddenMarkov):
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counts.zeros(states, CLASSES + 1)
        for batch in batches:
            for r in batch.to_pylist():
                model.expect(*_sequences(r, True), sums)
            pa.default_memory_pool().release_unused()
        whole = np.vstack([sums.emit.T, sums.move, sums.start, np.full(states, sums.log_likelihood)])
        at = np.flatnonzero(whole.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(whole[at, s]) for s in range(states))], ["cell", *(f"s{s}" for s in range(states))])

    return run


def train(blocks: DataFrame, frequency: np.ndarray, states: int, rounds: int, seed: int) -> tuple[HiddenMarkov, list[float]]:
    """The model after ``rounds`` of Baum-Welch over all training texts, and the log-likelihood before each round."""
    model, history = HiddenMarkov.initial(states, frequency, seed), []
    names = [f"s{s}" for s in range(states)]
    slim = blocks.select("sizes", "held", "tokens", "names")
    for _ in range(rounds):
        found = slim.mapInArrow(trimmed(_expectations(model)), "cell long, " + ", ".join(f"{n} double" for n in names))
        whole = np.zeros((CLASSES + 1 + states + 2, states))
        for r in found.groupBy("cell").agg(*(F.sum(n).alias(n) for n in names)).collect():
            whole[r["cell"]] = [r[n] for n in names]
        counts = Counts(whole[-2], whole[CLASSES + 1 : CLASSES + 1 + states], whole[: CLASSES + 1].T, float(whole[-1, 0]))
        history.append(counts.log_likelihood)
        model = HiddenMarkov.fitted(counts)
    return model, history


def _scores(model: HiddenMarkov, n_class: np.ndarray, v_class: np.ndarray, ends: int):
    n_all = int(n_class.sum()) + ends
    v_all = int(v_class.sum()) + (ends > 0)
    room = np.log10(n_class + v_class + 1.0)
    floor = np.log10(n_all + v_all + 1.0)

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("held_out", "n_tokens", "n_known", "base_score", "score")}
        ids = []
        name, n = told["name"].to_numpy(), told["n"].to_numpy()
        order = np.argsort(name)
        name, n = np.append(name[order], 0), np.append(n[order], 0)
        for r in blocks.to_pylist():
            own = np.frombuffer(r["names"], np.int64)
            tokens = np.frombuffer(r["tokens"], _kind(len(own)))
            at = np.searchsorted(name[:-1], own)
            counts = np.where(name[at] == own, n[at], 0)
            sizes = np.array(r["sizes"], dtype=np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            logs = np.log10(counts + 1.0)
            per = lambda x: np.bincount(doc, weights=x[tokens], minlength=len(sizes))  # noqa: B023, E731
            sums = per(logs)
            base = sums + np.log10(ends + 1.0) - (sizes + 1) * floor
            in_class = sums - per(room[_classes(r["names"])])
            score = model.log_likelihood(*_sequences(r, False)) / np.log(10.0) + in_class
            ids += r["ids"]
            for c, x in zip(out, (r["held"], sizes + 1, per(counts > 0).astype(np.int64) + (ends > 0), base, score), strict=True):
                out[c] += x if isinstance(x, list) else x.tolist()
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        kind = blocks.schema.field("ids").type.value_type
        return pa.table({"id": pa.array(ids, kind)} | {c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds, strict=True)} | {"train_tokens": pa.array([n_all] * len(ids), pa.int64())})

    return run


def score_texts(
    docs: DataFrame, folds: int = 7, held_fold: int = 2, states: int = 4, rounds: int = 5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are rows whose crc32(id as text) mod ``folds`` is ``held_fold``; all others are learnt from (a null id counts as an empty text).
    A null or empty text is its end alone. Repeated rows count as often as they occur. If nothing can be
    learnt, counts are zero and scores follow from that. An empty table gives an empty result. Other columns play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    slim = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    schema = f"bundle long, ids array<{kind}>, held array<boolean>, sizes array<long>, tokens binary, names binary, counts binary"
    blocks = materialize(slim.mapInArrow(trimmed(_blocks), schema), "word-blocks")
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    words = blocks.select("bundle", "names", "counts").mapInArrow(trimmed(_words), "bundle long, name long, n long")
    vocabulary = materialize(words.where("n > 0").groupBy("name").agg(F.sum("n").alias("n")), "vocabulary")
    n_class, v_class = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in vocabulary.groupBy(F.col("name").bitwiseAND(F.lit(CLASSES - 1)).alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    frequency = np.append(n_class, ends).astype(np.float64)
    model, _ = train(blocks, frequency / max(1.0, frequency.sum()), states, rounds, seed)
    asked = blocks.select("bundle", "names").mapInArrow(trimmed(_asked), "bundle long, name long")
    told = asked.join(vocabulary, "name").select("bundle", "name", "n")
    # a bundle is of bounded size, so as many partitions as there are bundles twice over bound a task, however many texts there are
    n = max(partitions(docs.sparkSession), 2 * blocks.select("bundle").distinct().count())
    rows = blocks.select("bundle", "ids", "held", "sizes", "tokens", "names").repartition(n, "bundle")
    told = told.repartition(n, "bundle")
    run = _scores(model, n_class, v_class, int(ends))
    out = rows.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(trimmed_group(run), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
