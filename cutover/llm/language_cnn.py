"""Language identification by a small byte convolutional network, in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed
length, each filter keeps its highest value, and a softmax over these gives
the language.  A text is cut into windows that cover all of it; the windows'
probabilities, weighted by their bytes, add up to the text's.

The network is fitted on the driver on a bounded sample of labelled rows
(``SAMPLE_ROWS``, of each language the same number of distinct texts, at most
``SAMPLE_PER_LANG``, or all it has; at most ``WINDOWS_PER_ROW`` windows of each) and travels to the tasks as its weights.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutover.llm.common import with_columns_by_batch

WINDOW = 256
EMBED = 4
WIDTHS = (2, 3, 4)
FILTERS = 10
SAMPLE_ROWS, SAMPLE_PER_LANG, WINDOWS_PER_ROW = 6_000, 1_500, 3
EPOCHS, LEAST_STEPS, BATCH, RATE = 3, 600, 64, 0.01
#: Windows that go through the filters at once.
AT_ONCE = 64
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_LEAD = max(WIDTHS) - 1


def windows_of(data: bytes) -> np.ndarray:
    """Windows that cover the bytes, the last one filled with zeros, each followed by zeros for the widest filter."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros((n, WINDOW + _LEAD), np.uint8)
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    out[:, :WINDOW] = flat.reshape(n, WINDOW)
    return out


class Network:
    """Embedding, filters of all widths as one matrix (narrow ones end in zeros), and the last layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.concatenate([np.repeat((np.arange(max(WIDTHS)) < w).repeat(EMBED)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.filters = (rng.normal(0, 0.4, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.last = rng.normal(0, 0.1, (self.mask.shape[1], len(languages))).astype(np.float32)
        self.last_bias = np.zeros(len(languages), np.float32)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest value of each filter over a window, where it is, and the patches."""
        patches = self._patches(windows)
        values = (patches.reshape(-1, self.filters.shape[0]) @ self.filters).reshape(len(windows), WINDOW, -1)
        where = values.argmax(1)
        return np.maximum(np.take_along_axis(values, where[:, None], 1)[:, 0] + self.bias, 0), where, patches

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(self.embed[windows])  # rows of EMBED values; a patch is so many rows in a row
        n, size = len(windows), max(WIDTHS) * EMBED
        step = flat.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(flat, (n, WINDOW, size), (step[0], step[1], step[2])))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), AT_ONCE):
            part = windows[at : at + AT_ONCE]
            values = (self._patches(part).reshape(-1, self.filters.shape[0]) @ self.filters).reshape(len(part), WINDOW, -1)
            out[at : at + AT_ONCE] = np.maximum(values.max(1) + self.bias, 0) @ self.last + self.last_bias
        return _softmax(out)

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam on cross entropy; each window is also cut to a random length, as short texts are."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "last", "last_bias")
        moments = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in names}
        step, epochs = 0, max(EPOCHS, -(-LEAST_STEPS * BATCH // len(windows)))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                x = windows[pick].copy()
                short = rng.random(len(pick)) < 0.3
                keep = np.where(short, rng.integers(12, WINDOW, len(pick)), WINDOW)
                x[np.arange(x.shape[1])[None] >= keep[:, None]] = 0
                grads = self._gradients(x, labels[pick])
                step += 1
                for n in names:
                    m, v = moments[n]
                    m += 0.1 * (grads[n] - m)
                    v += 0.001 * (grads[n] ** 2 - v)
                    rate = RATE * (1 - step / (epochs * -(-len(order) // BATCH) + 1))
                    getattr(self, n)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.embed[0] = 0

    def _gradients(self, x: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        top, where, patches = self.pooled(x)
        wrong = _softmax(top @ self.last + self.last_bias)
        wrong[np.arange(len(x)), labels] -= 1
        wrong /= len(x)
        back = (wrong @ self.last.T) * (top > 0)  # window by filter
        at = np.take_along_axis(patches, where[:, :, None], 1)  # window by filter by patch
        embed = np.zeros_like(self.embed)
        to_patch = (back[:, :, None] * self.filters.T[None]).reshape(*back.shape, max(WIDTHS), EMBED)
        of = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(embed, of.ravel(), to_patch.reshape(-1, EMBED))
        return {"embed": embed, "filters": np.einsum("bf,bfk->kf", back, at) * self.mask, "bias": back.sum(0), "last": top.T @ wrong, "last_bias": wrong.sum(0)}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def rows_of_each(counts: list[int]) -> int:
    """The highest number of rows a language may have so that no more than ``SAMPLE_ROWS`` come together."""
    left = SAMPLE_ROWS
    for k, n in enumerate(sorted(counts)):
        share = left // (len(counts) - k)
        if n > share:
            return min(share, SAMPLE_PER_LANG)
        left -= n
    return SAMPLE_PER_LANG


def trained(df: DataFrame, text: str = "text", lang: str = "lang") -> Network | None:
    """A network fitted on a sample of the rows that have a language and a text; None without such rows.

    Texts are picked by their hash, the first distinct ones of each language, so
    the sample depends neither on partitions nor on how often a text is repeated,
    and a language of a few texts has them all in the sample.
    """
    rows = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL AND length(text) > 0")
    rows = rows.withColumn("_hash", F.xxhash64("text", F.lit("sample")))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()  # no more languages than sampled rows
    if not counts:
        return None
    each = rows_of_each([r.n for r in counts])
    # a threshold that about twice as many texts are below leaves few to rank and hardly ever too few, also where the count is 10 % off
    steps = 1 << 30
    below = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(steps, steps * (2 * each + 50) // max(1, r.n) + 1))))
    size = F.length("text")
    middle = F.greatest(F.lit(1), F.floor((size - WINDOW) / 2).cast("int"))
    parts = F.array(F.substring("text", 1, WINDOW), F.col("text").substr(middle, F.lit(WINDOW)), F.col("text").substr(F.greatest(F.lit(1), size - WINDOW + 1), F.lit(WINDOW)))
    place = F.shiftrightunsigned("_hash", 34)
    picked = rows.filter(place < below[F.col("lang")]).select("lang", place.alias("_place"), "_hash", parts.alias("parts"))
    # copies of a text collapse where they are read
    picked = picked.groupBy("lang", "_place", "_hash").agg(F.min("parts").alias("parts"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "_hash"))
    picked = picked.withColumn("_k", first).filter(F.col("_k") <= each).orderBy("_place", "lang", "_hash").collect()
    languages = sorted({r.lang for r in picked})
    windows, labels = [], []
    for r in picked:
        for part in dict.fromkeys(r.parts[:WINDOWS_PER_ROW]):
            windows.append(windows_of(part.encode("utf-8", "replace")[:WINDOW]))
            labels.append(languages.index(r.lang))
    network = Network(languages)
    network.fit(np.concatenate(windows), np.array(labels))
    return network


def predict(network: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = []
    for t in texts:
        if network is None or not t or not _LETTER.search(t):
            out.append((UNKNOWN, 0.0))
            continue
        data = t.encode("utf-8", "surrogatepass")
        windows = windows_of(data)
        weight = np.full(len(windows), WINDOW, np.float64)
        weight[-1] = len(data) - WINDOW * (len(windows) - 1)
        p = weight @ network.probabilities(windows) / weight.sum()
        best = int(p.argmax())
        out.append((network.languages[best], min(1.0, float(p[best]))))
    return out


def with_language(df: DataFrame, network: Network | None, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``lang_pred`` and ``score``, the probability of that language.

    Text that is null or has no letter is ``und`` with score 0, and so is
    everything without a network.  Ties go to the language that sorts first;
    equal texts get equal results.
    """
    return with_columns_by_batch(df, "lang_pred string, score double", lambda texts: predict(network, texts), (text,), drop)
