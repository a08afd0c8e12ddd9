"""Language of whole texts: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.common import give_back, only, worker_state
from nightgrid.session import sent, write_once


#: Documented bounds of the fit: labelled rows, and characters taken from each of them.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 800
ORDERS, BUCKETS, WIDTH = 4, 1 << 16, 16
#: Rejection begins at this share of the familiarity that all but ``REJECT_SHARE`` of known texts reach.
REJECT_SHARE, REJECT_MARGIN = 0.0005, 0.6
UNKNOWN = "und"
#: Bytes of text read together, for each column of the table: their distinct pieces are held with a row each. And pieces looked up at a time.
GROUP_BYTES, PIECES = 48 << 20, 2048
MARKS = """.,;:!?'"()"""


def code_points(text: str):
    """Lower-cased code points with every run of non-letters as one space, a space at either end; and of each, how many line ends lie before it."""
    import numpy as np

    state = worker_state()
    if "letters" not in state:
        state["letters"] = np.char.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1"))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters, ends = state["letters"][codes], codes == ord("\n")
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first of a run of non-letters stays, as a space
    inner, line = np.where(letters, codes, 32)[keep], (np.cumsum(ends) - ends)[keep]
    return np.concatenate(([32], inner, [32])).astype(np.uint64), np.concatenate(([0], line, [ends.sum()]))


def subwords(codes):
    """Subwords of 1 to 4 code points of one word, whose edges count as a letter.

    For each length: by the code point it starts at, the bucket of the subword, and whether there is one.
    """
    import numpy as np

    space = codes == 32
    rolling, inside = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for order in range(1, ORDERS + 1):
        n = len(codes) - order + 1
        if n <= 0:
            break
        rolling = rolling[:n] * np.uint64(1_000_003) + codes[order - 1:]
        if order == 1:
            good = ~space
        else:
            # A space may only be the first or the last of them, and not both next to each other.
            inside = inside[:n] if order == 2 else inside[:n] & ~space[order - 2:order - 2 + n]
            good = inside & ~(space[:n] & space[order - 1:]) if order == 2 else inside
        mixed = (rolling ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(48)).astype(np.int64), good


def joined(arrays: Iterator[pa.Array], size: int) -> Iterator[pa.Array]:
    """Neighbouring arrays as one, of ``size`` bytes or a little more."""
    held = []
    for array in arrays:
        held.append(array)
        if sum(a.nbytes for a in held) >= size:
            together, held, array = pa.concat_arrays(held), [], None  # no second copy stays while the first is worked on
            yield together
    if held:
        yield pa.concat_arrays(held)


class LanguageModel:
    """Subword scores per language, a temperature and a rejection threshold.

    A text's embedding is the mean of its subwords' embeddings and its logits are linear in it, so
    the product of both matrices, one row of logits for each bucket, is all that prediction needs.
    A text's familiarity is the mean gap between the best and the worst language of its
    subwords: large for text in any mixture of known languages, small where subwords were
    never learned. Unlike the probability it does not fall where two known languages meet.
    """

    def __init__(self, langs: list[str], table, bias, temperature: float = 1.0, threshold: float = 0.0):
        import numpy as np

        gap = table.max(axis=1, keepdims=True) - table.min(axis=1, keepdims=True) if langs else np.zeros((len(table), 1), np.float32)
        self.table = np.concatenate((table, gap), axis=1)  # the last column is the gap
        self.langs, self.bias, self.temperature, self.threshold = langs, bias, temperature, threshold

    @functools.cached_property
    def rows(self):
        """The table with a last column of ones, which counts, and a last row of zeros, for a place without a subword."""
        import numpy as np

        return np.pad(np.pad(self.table, ((0, 0), (0, 1)), constant_values=1), ((0, 1), (0, 0)))

    def line_sums(self, text: str, block: int = 1 << 20):
        """For each line of the text the sum of its subwords' rows; long texts go block by block."""
        import numpy as np

        codes, line = code_points(text)
        total, at, spaces = np.zeros((line[-1] + 1, self.rows.shape[1])), 0, np.flatnonzero(codes == 32)
        while at < len(codes) - 1:  # blocks meet in a space, so no subword is split or met twice
            stop = int(spaces[min(np.searchsorted(spaces, at + block), len(spaces) - 1)])
            starting = np.zeros((stop + 1 - at, self.rows.shape[1]))
            for buckets, good in subwords(codes[at:stop + 1]):
                starting[:len(buckets)] += self.rows.take(np.where(good, buckets, BUCKETS), axis=0)
            # A subword is of the line of its second code point: a space is of the line before it.
            lines = line[at + 1:stop + 1]
            first = np.flatnonzero(np.diff(lines, prepend=-1))
            total[lines[first]] += np.add.reduceat(starting, first, axis=0)
            at = stop
        return total

    def text_sums(self, texts: pa.Array):
        """For each text the sum of its subwords' rows.

        White space ends every subword, so that sum is the sum over the pieces between white space, and a piece
        that occurs often is read once. Capital letters and marks around a piece make no other subwords.
        """
        import numpy as np

        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        pieces = pc.ascii_trim(split.flatten(), MARKS).dictionary_encode()
        distinct, numbers, edges = pieces.dictionary, pieces.indices.to_numpy(), split.offsets.to_numpy()
        del split, pieces
        sums = np.zeros((len(distinct), self.rows.shape[1]))
        for at in range(0, len(distinct), PIECES):
            sums[at:at + PIECES] = self.line_sums("\n".join(distinct.slice(at, PIECES).to_numpy(zero_copy_only=False)))
        total = np.zeros((len(texts), self.rows.shape[1]))
        for i, (start, stop) in enumerate(zip(edges[:-1], edges[1:])):
            total[i] = sums.take(numbers[start:stop], axis=0).sum(axis=0)
        return total

    def means(self, sums):
        """(mean logits, familiarity) by text."""
        import numpy as np

        mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        return mean[:, :-1] + self.bias, mean[:, -1]

    def judge(self, sums) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(language, probability, accepted) by text."""
        import numpy as np

        lettered, best, score = (sums[:, -1] > 0) & bool(self.langs), np.zeros(len(sums), np.int64), np.zeros(len(sums))
        logits, familiarity = self.means(sums)
        if self.langs:
            z = logits / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            best = p.argmax(axis=1)
            score = np.where(lettered, np.clip(p[np.arange(len(p)), best] / p.sum(axis=1), 0, 1), 0)
        names = pa.array([*self.langs, UNKNOWN], pa.string())
        return names.take(pa.array(np.where(lettered, best, len(self.langs)))), pa.array(score), pa.array(lettered & (familiarity >= self.threshold))

    def measure(self, text: str, block: int = 1 << 20):
        """(mean logits, familiarity) of the whole text, or None without letters."""
        sums = self.line_sums(text, block).sum(axis=0, keepdims=True)
        logits, familiarity = self.means(sums)
        return (logits[0], float(familiarity[0])) if sums[0, -1] else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, accepted)."""
        return tuple(column[0].as_py() for column in self.judge(self.line_sums(text or "").sum(axis=0, keepdims=True)))

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], seed: int = 7, epochs: int = 6, rate: float = 0.4, batch: int = 32, least_steps: int = 600) -> LanguageModel:
        """Stochastic gradient descent on four fifths of the examples; the rest calibrates.

        The temperature is the one of a grid with the smallest loss on the calibration part; the
        threshold is ``REJECT_MARGIN`` of the familiarity that all but ``REJECT_SHARE`` of that part reach.
        """
        import numpy as np

        langs = sorted(set(labels))
        if not langs:
            return cls([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
        rng = np.random.default_rng(seed)
        grams = [np.concatenate([buckets[good] for buckets, good in subwords(code_points(t)[0])]) for t in texts]
        distinct = [np.unique(g, return_counts=True) for g in grams]
        y = np.array([langs.index(label) for label in labels])
        usable = np.array([i for i, g in enumerate(grams) if len(g)], dtype=np.int64)
        order = rng.permutation(usable)
        train, held = order[len(order) // 5:], order[:len(order) // 5]
        embed = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
        weight, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
        batches = max(1, -(-len(train) // batch))
        epochs = max(epochs, -(-least_steps // batches))  # small samples are gone through more often
        steps, step = epochs * batches, 0
        for _ in range(epochs):
            rng.shuffle(train)
            for at in range(0, len(train), batch):
                rows = train[at:at + batch]
                sizes = np.array([len(grams[i]) for i in rows])
                ids = np.concatenate([grams[i] for i in rows])
                mean = np.add.reduceat(embed.take(ids, axis=0), np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
                z = mean @ weight + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                pace = rate * (1 - step / steps) * 4
                back = (p @ weight.T) / sizes[:, None]
                weight -= pace * (mean.T @ p) / len(rows)
                bias -= pace * p.mean(axis=0) * 0.1
                # One addition for each bucket and example, not for each occurrence.
                for i, change in zip(rows, back):
                    buckets, times = distinct[i]
                    embed[buckets] += (-pace * times[:, None] * change).astype(np.float32)
                step += 1
        model = cls(langs, (embed @ weight).astype(np.float32), bias.astype(np.float64))
        means = np.array([model.table[grams[i]].mean(axis=0) for i in held]).reshape(len(held), len(langs) + 1)
        z = means[:, :-1] + model.bias
        if len(held):

            def probabilities(temperature: float):
                e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
                return e / e.sum(axis=1, keepdims=True)

            loss = lambda t: -np.log(probabilities(t)[np.arange(len(held)), y[held]] + 1e-12).mean()
            model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
            model.threshold = REJECT_MARGIN * float(np.quantile(means[:, -1], REJECT_SHARE))
        return model


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Fit on a bounded sample of (doc_id, text, lang) rows outside fold 2 with a language and a text.

    At most ``rows`` rows, chosen by a hash of id and text whose threshold follows from the count of their language, then in
    the order of hash against threshold: half of the bound goes to languages in proportion to their rows, half in equal parts, so that a rare
    language is learned and a frequent one does not take all. Of each row at most ``chars`` characters are read, from a place that the hash picks. So any
    order of the rows gives the same model, and rows that share an id are chosen one by one.
    """
    known = only(docs, "doc_id", "text", "lang").where((F.coalesce(fold(F.col("doc_id")), F.lit(0)) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    each = write_once(known.groupBy("lang").agg(F.count("*").alias("_rows")), "language-counts")
    count, langs = each.agg(F.sum("_rows"), F.count("*")).first()
    mark = F.xxhash64("doc_id", "text", F.lit("language sample"))
    rank = (mark.cast("double") + 2.0**63) / 2.0**64  # uniform between 0 and 1
    if count and count > rows:
        # As many rows have a rank below 1 as are wanted, give or take; the limit is the hard bound.
        rank = rank / F.least(F.lit(1.0), 0.475 * rows * (1.0 / count + 1.0 / (langs * F.col("_rows"))))
        known = known.join(sent(each), "lang").where(rank <= 1)
    length = F.length("text")
    start = F.when(length > chars, F.pmod(F.xxhash64("doc_id", "text", F.lit("place")), (length - chars).cast("long"))).otherwise(0).cast("int") + 1
    # Half of the windows are short, so that short texts are judged as surely as long ones.
    size = F.when(mark % 2 == 0, F.lit(chars)).otherwise(F.lit(chars // 8))
    sample = known.select(rank.alias("rank"), mark.alias("mark"), "doc_id", F.col("text").substr(start, size).alias("text"), "lang").orderBy("rank", "mark", "lang").limit(rows).collect()
    sample.sort(key=lambda r: (str(r.doc_id), r.text))
    return LanguageModel.fit([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """Add column ``into``: a struct of lang_pred, score and accepted, read off the whole text alone.

    lang_pred is a learned language, or ``und`` with score 0 if the text is null or has no letter.
    accepted is false for those and for texts less familiar than the calibrated threshold. Every row stays,
    repeated ones too; an empty table gives no rows; a column of that name is replaced.
    """

    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in joined(batches, GROUP_BYTES // (len(model.langs) + 2)):
            yield pa.StructArray.from_arrays(model.judge(model.text_sums(texts)), ["lang_pred", "score", "accepted"])
        give_back()

    return docs.withColumn(into, predict(F.col(text)))
