"""Which encoding a text file has: by its form where that tells, else by what its letters would be.

A byte order mark decides.  Text of ASCII alone needs no decision.  A multi-byte encoding is told by its
state machine: bytes that pass it by chance are rare, and rarer with each further sequence.  UTF-16 without a mark
shows in zero bytes on one side.  Single-byte encodings accept anything, so each is tried, and each letter
that it gives is judged against those of the others in its place: by the windows of three, five and seven characters
around a letter beyond ASCII, as texts that are known to be right have them.  Where a wide window is rare,
narrower ones count for more, and in the end pairs of neighbours.  A window that a text repeats tells nothing new.
The likeliest encoding is taken, with the share of its text's pairs that are known as confidence.  Below one half
nothing is known, and the text is read as UTF-8 with replacement characters.

The windows are counted by Spark over whole texts; the most frequent ``MOST_PAIRS`` pairs and ``MOST_WINDOWS``
windows of each width go to the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.sources.shared import written

MOST_PAIRS, MOST_WINDOWS, MOST_SEEN = 50_000, 500_000, 100_000
SINGLE_BYTE = ("cp1252", "cp1258", "cp850", "mac_roman")
FOUND = T.StructType([T.StructField("encoding", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("text", T.StringType())])
_PAIR = re.compile(r"(?s)(?=(.[^\x00-\x7f]|[^\x00-\x7f].))")
_BYTES = re.compile(rb"(?s)(?=(...[\x80-\xff]...))")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def fit(docs: DataFrame, text: str = "text", most: int = MOST_PAIRS, most_windows: int = MOST_WINDOWS) -> dict[str, float]:
    """Log-likelihoods of the pairs of neighbours with a letter beyond ASCII, and of the windows of three, five and seven
    characters around such a letter, from texts that are right.  Beyond a text's ends are line feeds."""
    ends = F.lit("\n" * 3)
    wide = docs.select(F.explode(F.regexp_extract_all(F.concat(ends, F.col(text), ends), F.lit(r"(?s)(?=(...[^\x00-\x7f]...))"), F.lit(1))).alias("w"))
    wide = wide.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    part = lambda start, length: F.substring("w", start, length)
    # a pair of two such letters is counted once, from the first of them
    parts = F.array(F.when(part(3, 1).rlike(r"\A[\x00-\x7f]"), part(3, 2)), part(4, 2), part(3, 3), part(2, 5), F.col("w"))
    counted = written(wide.select("n", F.explode(parts).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.sum("n").alias("n")))
    model = {}
    for length in (2, 3, 5, 7):
        own = counted.where(F.length("k") == length)
        # the least count of which, with all greater ones, no more windows have it than may go to the tasks
        left, least = most if length == 2 else most_windows, None
        for r in own.groupBy("n").agg(F.count(F.lit(1)).alias("windows")).orderBy(F.desc("n")).collect():
            left -= r.windows
            if left < 0:
                break
            least = r.n
        found = own.where(F.col("n") >= least).toArrow() if least is not None else None
        if found is not None:
            counts = found["n"].to_pylist()
            total = sum(counts)
            logs = {n: math.log(n / total) for n in set(counts)}
            model.update((k, logs[n]) for k, n in zip(found["k"].to_pylist(), counts, strict=True))
    return model


def _strict(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except (UnicodeDecodeError, ValueError):
        return None


class Judge:
    """Judges files by a model that :func:`fit` made."""

    def __init__(self, model: dict[str, float]):
        self.model, self.seen = model, {}
        self.rare = {n: math.exp(min((x for k, x in model.items() if len(k) == n), default=0.0)) for n in (2, 3, 5, 7)}

    def __call__(self, data: bytes) -> tuple[str, float, str]:
        """(encoding, confidence, text)."""
        for mark, encoding in _MARKS:
            if data.startswith(mark) and (text := _strict(data, encoding)) is not None:
                return encoding, 1.0, text
        sides = [data[0::2].count(0), data[1::2].count(0)]
        if sum(sides):
            # of text in a Latin script one byte of two is zero, always on the same side
            encoding = "utf-16-le" if sides[1] > sides[0] else "utf-16-be"
            share = max(sides) / max(1, len(data) // 2)
            if len(data) % 2 == 0 and share > 0.2 and min(sides) * 20 <= max(sides) and (text := _strict(data, encoding)) is not None:
                return encoding, min(1.0, 0.5 + share / 2), text
        if data.isascii():
            return "ascii", 1.0, data.decode("ascii")
        if (text := _strict(data, "utf-8")) is not None:
            sequences = sum(b >= 0xC0 for b in data)
            return "utf-8", 1.0 - 0.5 ** (sequences + 1), text
        scores = [0.0] * len(SINGLE_BYTE)
        for window in dict.fromkeys(_BYTES.findall(b"\n\n\n" + data + b"\n\n\n")):
            scores = [s + x for s, x in zip(scores, self._likelihoods(window), strict=True)]
        best = max(range(len(SINGLE_BYTE)), key=scores.__getitem__)
        text = _strict(data, SINGLE_BYTE[best]) or ""
        found = Counter(_PAIR.findall(text))
        confidence = sum(n for p, n in found.items() if p in self.model) / max(1, found.total())
        if confidence < 0.5:
            return "utf-8", confidence, data.decode("utf-8", "replace")
        return SINGLE_BYTE[best], confidence, text

    def _likelihoods(self, window: bytes) -> list[float]:
        """For each encoding, the logarithm of the share of its letter among those that all give in a window's middle."""
        if window in self.seen:
            return self.seen[window]
        texts = [_strict(window, e) for e in SINGLE_BYTE]
        known = lambda k: math.exp(self.model[k]) if k in self.model else 0.0
        floor = self.rare[2] / 100
        weights = {t[3]: (known(t[2:4]) + floor) * (known(t[3:5]) + floor) for t in texts if t}
        shares = [weights[t[3]] / sum(weights.values()) if t else 0.0 for t in texts]
        for cut in (slice(2, 5), slice(1, 6), slice(0, 7)):
            # the rarest known window counts as much as what is narrower
            rare, weights = self.rare[cut.stop - cut.start], {t[3]: known(t[cut]) for t in texts if t}
            shares = [(weights[t[3]] + rare * p) / (sum(weights.values()) + rare) if t else 0.0 for t, p in zip(texts, shares, strict=True)]
        found = [math.log(p) if p else -math.inf for p in shares]
        if len(self.seen) < MOST_SEEN:
            self.seen[window] = found
        return found


def judge(data: bytes, pairs: dict[str, float]) -> tuple[str, float, str]:
    """(encoding, confidence, text)."""
    return Judge(pairs)(data)


def detected(content: Column, pairs: dict[str, float]) -> Column:
    """struct(encoding, confidence, text) of a file's bytes; null for null."""

    judged = Judge(pairs)

    @F.pandas_udf(FOUND)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if d is None else judged(bytes(d)) for d in data], columns=FOUND.names)

    return run(content)
