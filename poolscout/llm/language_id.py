"""Language identification with interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A model predicts each letter of a word, and its end, from the three characters before it; what stands before a word is padding, so
that texts and words do not depend on each other. A text gets the language of the lowest cross-entropy per character.

Every 4-gram of every training row is in the model. A model that fits in a task's memory is broadcast; of a larger one the most
frequent grams are, and slices of texts get the log probabilities of their other grams by a join. Both estimate the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_slices, saved, slices
from .compression import calibrate
from .textkernel import mix

ORDER = 4
#: Bytes of text at a time; every byte takes some two hundred in temporaries.
SLICE_BYTES = 1_000_000
_U = np.uint64
_BITS = _U(16)
#: Letters beyond the basic plane are one symbol to the models.
ASTRAL = 0xFFFE


@dataclass(frozen=True)
class Options:
    """``held`` numbers of the model, one per 4-gram and language, are in a task's memory at most; where the others are looked up
    changes no result. ``calibration`` rows at most fit the score. ``least_z`` is the 99.9th percentile of normal scores, for
    languages of too few calibration rows to show it."""

    held: int = 8_000_000
    calibration: int = 20_000
    least_z: float = 3.09
    slack: float = 1.25


_letters: np.ndarray | None = None


def letter_codes() -> np.ndarray:
    """Per code point of the basic plane the lower-case letter, or 0 for what is not a letter."""
    global _letters
    if _letters is None:
        table = np.zeros(0x10000, dtype=np.uint16)
        for code in range(1, 0x10000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else code
        _letters = table
    return _letters


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, or 0, of all texts, each followed by one 0; and where each text begins."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    far = raw > 0xFFFF
    codes = letter_codes()[np.where(far, 0, raw)]
    if far.any():
        found, back = np.unique(raw[far], return_inverse=True)
        codes[far] = np.array([ASTRAL if chr(c).isalpha() else 0 for c in found], dtype=np.uint16)[back]
    return codes, np.concatenate(([0], np.cumsum(lengths)))


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each letter and at each end of a word, and where."""
    last = [codes.astype(_U)]
    for back in range(1, ORDER):
        shifted = np.zeros(len(codes), dtype=_U)
        shifted[back:] = codes[:-back] if back else codes
        if back > 1:
            shifted[last[-1] == 0] = 0
        last.append(shifted)
    at = np.flatnonzero((codes > 0) | (last[1] > 0))
    key = np.zeros(len(at), dtype=_U)
    for part in reversed(last):
        key = (key << _BITS) | part[at]
    return key, at


def _mask(order: int) -> np.uint64:
    return _U(2 ** (16 * order) - 1)


@dataclass
class Model:
    """Per order a sorted array of hashes with a row of log probabilities for each language, and the same of histories with
    the weight that an unseen continuation carries over to the order below."""

    languages: list[str]
    hashes: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    history: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each gram's last symbol after the others, a column per language."""
        out = np.empty((len(keys), len(self.languages)), dtype=np.float32)
        if order == 0:
            out[:] = self.floor
            return out
        row, found = _find(self.hashes[order - 1], keys & _mask(order))
        out[found] = self.logs[order - 1][row[found]]
        rest = np.flatnonzero(~found)
        if len(rest):
            lower = self.log_probability(keys[rest], order - 1)
            if order > 1:
                row, found = _find(self.history[order - 1], (keys[rest] & _mask(order)) >> _BITS)
                lower[found] += self.weights[order - 1][row[found]]
            else:
                lower += self.weights[0][0]
            out[rest] = lower
        return out


def _find(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(hashes) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    wanted = mix(keys, 41)
    row = np.searchsorted(hashes, wanted)
    row[row == len(hashes)] = 0
    return row, hashes[row] == wanted


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from each language's 4-gram counts.

    Below the highest order a gram counts by how many symbols are seen before it; grams that begin with padding keep their plain
    counts, as nothing but padding ever stands before them. The discount of each order is ``n1 / (n1 + 2 n2)``.
    """
    model = Model(languages)
    adjusted: list[list[tuple[np.ndarray, np.ndarray]]] = [None] * (ORDER + 1)  # type: ignore[list-item]
    adjusted[ORDER] = [(k, c.astype(float)) for k, c in counts]
    for order in range(ORDER - 1, 0, -1):
        level = []
        for keys, numbers in adjusted[order + 1]:
            low, back = np.unique(keys & _mask(order), return_inverse=True)
            types = np.bincount(back, minlength=len(low)).astype(float)
            plain = np.bincount(back, weights=numbers, minlength=len(low))
            padded = (low >> _U(16 * (order - 1))) == 0 if order > 1 else np.zeros(len(low), bool)
            level.append((low, np.where(padded, plain, types)))
        adjusted[order] = level
    symbols = np.unique(np.concatenate([k for k, _ in adjusted[1]])) if languages else np.empty(0, _U)
    model.floor = np.full(len(languages), -np.log(len(symbols) + 2), dtype=np.float32)
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in adjusted[order]]))
        union = union[np.argsort(mix(union, 41))]
        past = np.unique(union >> _BITS)
        past = past[np.argsort(mix(past, 41))]
        lower = model.log_probability(union, order - 1).astype(float)
        logs, weights = np.empty((len(union), len(languages))), np.zeros((len(past), len(languages)))
        for column, (keys, numbers) in enumerate(adjusted[order]):
            ones, twos = (numbers == 1).sum(), (numbers == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and ones + 2 * twos else 0.5
            heads, back = np.unique(keys >> _BITS, return_inverse=True)
            mass = np.bincount(back, weights=numbers, minlength=len(heads))
            kinds = np.bincount(back, minlength=len(heads))
            row, found = _lookup(heads, past)
            share = np.where(found, discount * kinds[row] / mass[row], 1.0) if len(heads) else np.ones(len(past))
            weights[:, column] = np.log(share)
            row, found = _lookup(keys, union)
            of, known = _lookup(heads, union >> _BITS)
            if len(keys):
                direct = np.where(found, (numbers[row] - discount) / mass[of], 0.0)
                carried = np.where(known, discount * kinds[of] / mass[of], 1.0)
            else:
                direct, carried = np.zeros(len(union)), np.ones(len(union))
            logs[:, column] = np.log(direct + carried * np.exp(lower[:, column]))
        model.hashes.append(mix(union, 41))
        model.logs.append(logs.astype(np.float32))
        model.history.append(mix(past, 41))
        model.weights.append(weights.astype(np.float32))
    return model


def _lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(sorted_keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return row, sorted_keys[row] == wanted


@dataclass
class SpreadModel:
    """The model of ``build`` as tables. Per order ``seen`` has ``(key, seen)``, the languages of each gram with their adjusted
    counts, and ``past`` has ``(head, past)``, the languages of each history with their sums of counts and kinds of continuations."""

    languages: list[str]
    seen: list[DataFrame]
    past: list[DataFrame]
    discounts: np.ndarray
    floor: float
    frequent: DataFrame

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """``(key, p)``: the probability of each ``gram`` in every language, as doubles one after another. A gram shares its history
        and its end with no more others than there are symbols, so that no key of these joins is heavy."""
        k, lower = len(self.languages), None
        for order in range(1, ORDER + 1):
            keys = grams.select(_low(F.col("gram"), order).alias("key")).distinct()
            rows = keys.join(self.seen[order - 1], "key", "left").withColumn("head", F.shiftrightunsigned("key", 16))
            past = self.past[order - 1]
            rows = rows.join(F.broadcast(past) if order == 1 else past, "head", "left")  # order 1 has one history
            if lower is None:
                rows = rows.withColumn("p", F.lit(np.full(k, self.floor).tobytes()))
            else:
                rows = rows.withColumn("end", _low(F.col("key"), order - 1)).join(lower.withColumnRenamed("key", "end"), "end")

            def step(batches, discount=self.discounts[order - 1]):
                for batch in batches:
                    number, = _dense(batch.column(1), ["n"], k)
                    mass, kinds = _dense(batch.column(2), ["mass", "kinds"], k)
                    below = _doubles(batch.column(3), k)
                    known = np.maximum(mass, 1)
                    direct = np.where(number > 0, (number - discount) / known, 0.0)
                    p = direct + np.where(mass > 0, discount * kinds / known, 1.0) * below
                    yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in p], pa.binary())], names=["key", "p"])

            lower = rows.select("key", "seen", "past", "p").mapInArrow(step, "key long, p binary")
        return lower


def _low(gram, order: int):
    """The last ``order`` symbols of a column of grams."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit(2 ** (16 * order) - 1).cast("long"))


def _dense(column: pa.Array, names: list[str], width: int) -> list[np.ndarray]:
    """The named numbers of lists of structs, in the columns that their ``l`` says."""
    row = np.repeat(np.arange(len(column)), np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
    flat = column.flatten()
    at = np.asarray(pc.struct_field(flat, "l"))
    out = [np.zeros((len(column), width)) for _ in names]
    for table, name in zip(out, names):
        table[row, at] = np.asarray(pc.struct_field(flat, name))
    return out


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=float).reshape(len(column), width)


def spread(counted: DataFrame, languages: list[str], held: int) -> SpreadModel:
    """What ``build`` does, by aggregates over ``(lang, gram, n)``."""
    number = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    level = counted.select(number[F.col("lang")].alias("l"), F.col("gram").alias("key"), "n")
    frequent = level.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(held).select(F.col("key").alias("gram"))
    seen, past, discounts = [], [], np.full((ORDER, len(languages)), 0.5)
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            low = _low(F.col("key"), order)
            padded = F.shiftrightunsigned("key", 16 * (order - 1)) == 0 if order > 1 else F.lit(False)
            level = level.select("l", low.alias("key"), "n").groupBy("l", "key").agg(F.sum("n").alias("plain"), F.count("*").alias("types"))
            level = level.select("l", "key", F.when(padded, F.col("plain")).otherwise(F.col("types")).alias("n"))
        level, _ = saved(level, f"level-{order}")
        for r in level.groupBy("l").agg(F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos")).collect():
            if r["ones"]:
                discounts[order - 1, r["l"]] = r["ones"] / (r["ones"] + 2 * r["twos"])
        heads = level.groupBy("l", F.shiftrightunsigned("key", 16).alias("head")).agg(F.sum("n").alias("mass"), F.count("*").alias("kinds"))
        seen.insert(0, saved(level.groupBy("key").agg(F.collect_list(F.struct("l", "n")).alias("seen")), f"seen-{order}")[0])
        past.insert(0, saved(heads.groupBy("head").agg(F.collect_list(F.struct("l", "mass", "kinds")).alias("past")), f"past-{order}")[0])
    return SpreadModel(languages, seen, past, discounts, 1 / (seen[0].count() + 2), saved(frequent, "frequent")[0])


def train(texts: DataFrame, options: Options = Options()) -> Model | SpreadModel:
    """Models of ``(lang, text)``. Every row is counted and every gram kept; tasks add up their own counts first."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages = np.array(batch.column(0).to_pylist(), dtype=object)
        codes, bounds = code_points(batch.column(1).to_pylist())
        key, at = grams(codes)
        names, of = np.unique(languages, return_inverse=True)
        owner = of[np.searchsorted(bounds, at, side="right") - 1]
        out = ([], [], [])
        for i, name in enumerate(names):
            keys, numbers = np.unique(key[owner == i], return_counts=True)
            out[0].extend([name] * len(keys))
            out[1].append(keys.view(np.int64))
            out[2].append(numbers)
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out[1:]]
        return pa.record_batch([pa.array(out[0], pa.string()), pa.array(joined[0]), pa.array(joined[1])], names=["lang", "gram", "n"])

    rows = texts.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counted, _ = saved(
        map_slices(rows, count, "lang string, gram long, n long", size=SLICE_BYTES).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"
    )
    sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([])
    if sum(sizes.values()) * len(languages) > options.held:
        return spread(counted, languages, max(1, options.held // len(languages)))
    model_rows = counted.toPandas()
    counts = []
    for lang in languages:
        own = model_rows[model_rows["lang"] == lang]
        keys = own["gram"].to_numpy(dtype=np.int64).view(_U)
        order = np.argsort(keys)
        counts.append((keys[order], own["n"].to_numpy(dtype=np.int64)[order]))
    return build(languages, counts)


SCORES = "doc_id long, lang string, fold int, fp long, best int, bits double, second double, spread double, n long"


def _scores(batch: pa.RecordBatch | pa.Table, k: int, look_up: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The rows of ``SCORES`` for ``(doc_id, lang, fold, text, fp)``, given the log probabilities of grams in ``k`` languages."""
    codes, bounds = code_points([t or "" for t in batch.column(3).to_pylist()])
    key, at = grams(codes)
    owner_first = np.searchsorted(at, bounds)
    n = np.diff(owner_first)
    rows = len(n)
    best, bits, second, spread = np.full(rows, -1, np.int32), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    full = np.flatnonzero(n > 0)
    if k and len(full):
        logs = look_up(key) / np.float32(-np.log(2))
        begin = owner_first[:-1][full]
        mean = np.add.reduceat(logs.astype(float), begin, axis=0) / n[full][:, None]
        squares = np.add.reduceat(logs.astype(float) ** 2, begin, axis=0) / n[full][:, None]
        order = np.argsort(mean, axis=1, kind="stable")
        here = np.arange(len(full))
        best[full] = order[:, 0]
        bits[full] = mean[here, order[:, 0]]
        second[full] = mean[here, order[:, min(1, k - 1)]]
        spread[full] = np.maximum(squares[here, order[:, 0]] - bits[full] ** 2, 0)
    arrays = [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(best), pa.array(bits), pa.array(second), pa.array(spread), pa.array(n, pa.int64())]
    arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays]
    return pa.record_batch(arrays, names=[x.split()[0] for x in SCORES.split(", ")])


def score_texts(docs: DataFrame, model: Model | SpreadModel) -> DataFrame:
    """Per row of ``(doc_id, lang, fold, text)``: the best language, its bits per character, the second best's, the variance of
    the bits of single characters and the number of characters; ``best`` is -1 without letters. ``fp`` tells texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "fold", text.alias("text"), F.xxhash64(text).alias("fp"))
    if isinstance(model, SpreadModel):
        return _score_by_join(rows, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Options.held

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _scores(batch, len(shared.value.languages), shared.value.log_probability)

    return map_slices(rows, step, SCORES, size=SLICE_BYTES)


def _score_by_join(rows: DataFrame, model: SpreadModel) -> DataFrame:
    """``score_texts`` with a model that no task holds. A slice of texts asks once for each gram that is not among the frequent
    ones, and gets the answers beside its texts."""
    k = len(model.languages)
    frequent = model.probabilities(model.frequent).toPandas()  # bounded by Options.held
    order = np.argsort(frequent["key"].to_numpy(dtype=np.int64))
    keys = frequent["key"].to_numpy(dtype=np.int64)[order]
    logs = np.log(_doubles(pa.array(frequent["p"], pa.binary()), k)[order]).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((keys, logs))

    def number(batches):
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 3, SLICE_BYTES):
                yield pa.record_batch([*piece.columns, pa.array(np.full(piece.num_rows, (task << 32) + count))], names=[*piece.schema.names, "slice"])
                count += 1

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, bounds = code_points(batch.column(3).to_pylist())
        key, at = grams(codes)
        key, of = key.view(np.int64), np.asarray(batch.column(5))[np.searchsorted(bounds, at, side="right") - 1]
        asked, by = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for name in np.unique(of):
            own = np.unique(key[of == name])
            asked.append(own[~_lookup(shared.value[0], own)[1]])
            by.append(np.full(len(asked[-1]), name))
        return pa.record_batch([pa.array(np.concatenate(by)), pa.array(np.concatenate(asked))], names=["slice", "gram"])

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = np.asarray(answers.column("key"), dtype=np.int64)
        own, first = np.unique(own, return_index=True)
        own_logs = np.log(_doubles(answers.column("p"), k)[first]).astype(np.float32)

        def look_up(key: np.ndarray) -> np.ndarray:
            key = key.view(np.int64)
            row, found = _lookup(shared.value[0], key)
            out = shared.value[1][row]
            rest = np.flatnonzero(~found)
            row, found = _lookup(own, key[rest])
            if not found.all():
                raise RuntimeError("grams of a slice without an answer")
            if len(rest):
                out[rest] = own_logs[row]
            return out

        return pa.Table.from_batches([_scores(texts, k, look_up)])

    texts, _ = saved(rows.mapInArrow(number, "doc_id long, lang string, fold int, text string, fp long, slice long"), "language-slices")
    asked, _ = saved(map_slices(texts, ask, "slice long, gram long", size=SLICE_BYTES), "asked-grams")
    wanted, _ = saved(asked.select("gram").distinct(), "wanted-grams")
    answers = asked.join(model.probabilities(wanted).withColumnRenamed("key", "gram"), "gram").select("slice", F.col("gram").alias("key"), "p")
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, SCORES)


def identify(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected, bits, fp)`` for every row; ``fp`` is the hash of the text, a null one as empty.

    Learns from rows outside fold 0 that have a language: folds 2 to 4 give the counts, fold 1 the calibration. A text that is
    null or has no letter is ``und`` with score 0 and rejected. Others get the language of the lowest bits per character, and are
    rejected if these lie further above what is usual for texts of that language and length than any but one in a thousand
    of the calibration rows (with some slack, and ``least_z`` standard deviations at least). A language without a correctly
    recognised calibration row is held to what is usual for all languages together, and one of fewer than 30 varies as much as
    they do at least; without any such row in the table nothing with a letter is rejected. Without any language to learn, all
    are ``und``. Repeated rows give repeated results.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")
    ).withColumn("fold", F.coalesce(fold().cast("int"), F.lit(0)))
    model = train(rows.where("fold > 1"), options)
    scores, _ = saved(score_texts(rows, model), "language-scores")
    names = model.languages
    known = scores.where("fold = 1 AND lang IS NOT NULL AND best >= 0").withColumn(
        "right", F.col("lang") == F.element_at(F.array(*[F.lit(x) for x in names] or [F.lit("")]), F.col("best") + 1)
    )
    # a row per language, and one of all together under None
    usual = {
        r["best"]: (r["mean"], r["between"] or 0.0, r["within"], r["rows"])
        for r in known.where("right").rollup("best").agg(F.avg("bits").alias("mean"), F.var_pop("bits").alias("between"), F.avg("spread").alias("within"), F.count("*").alias("rows")).collect()
    }
    z, pooled = F.lit(0.0), usual.get(None)
    if pooled:
        standard = lambda mean, between, within: (F.col("bits") - mean) / F.sqrt(F.lit(between) + F.lit(within + 1e-6) / F.col("n"))
        z = standard(*pooled[:3])
        for best, (mean, between, within, rows_of) in usual.items():
            if best is not None:
                z = F.when(F.col("best") == best, standard(mean, max(between, pooled[1]) if rows_of < 30 else between, within)).otherwise(z)
    far = {r["best"]: r["far"] for r in known.where("right").withColumn("z", z).rollup("best").agg(F.percentile_approx("z", 0.999, 10_000).alias("far")).collect()}
    limit = F.lit(max(options.least_z, options.slack * far.pop(None, 0.0)))
    for best, value in far.items():
        limit = F.when(F.col("best") == best, F.lit(max(options.least_z, options.slack * value))).otherwise(limit)
    sample = known.select("doc_id", (F.col("second") - F.col("bits")).alias("margin"), "n", "right").orderBy(F.xxhash64("doc_id"), "margin").limit(options.calibration).collect()
    evidence = lambda margin, n: margin * np.sqrt(n)
    x = np.array([evidence(r["margin"], r["n"]) for r in sample], dtype=float)
    y = np.array([r["right"] for r in sample], dtype=float)
    slope, offset = calibrate(x, y)
    if slope <= 0:  # nothing was wrong, so nothing tells how sure to be: a margin of one standard unit is even
        slope, offset = 1.0, 0.0
    lettered = F.col("best") >= 0
    sure = 1 / (1 + F.exp(-(F.lit(slope) * (F.col("second") - F.col("bits")) * F.sqrt("n") + F.lit(offset))))
    return scores.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        F.when(lettered, F.element_at(F.array(*[F.lit(x) for x in names] or [F.lit("und")]), F.greatest(F.col("best") + 1, F.lit(1)))).otherwise("und").alias("lang_pred"),
        F.when(lettered, sure).otherwise(F.lit(0.0)).alias("score"),
        (~lettered | (z > limit)).alias("rejected"),
        "bits",
        "fp",
    )
