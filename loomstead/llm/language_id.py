"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import by_size, tidy

UNKNOWN = "und"
#: Characters of texts that are worked on at once; a longer text is cut where it has no letter.
BLOCK = 200_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to its lower-case code point, or to a space where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def blocks(text: str) -> list[str]:
    """A text in parts that end before a character that is no letter, so that they have the text's n-grams together."""
    if len(text) <= BLOCK:
        return [text]
    cuts = [0]
    while len(text) - cuts[-1] > BLOCK:
        at = cuts[-1] + BLOCK
        while at < len(text) and text[at].isalpha():
            at += 1
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def grams(texts: list[str], buckets: int, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its text, whether each text has a letter), over letters and single gaps, vectorised."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    gap = b" \0\0\0"
    code = _letters()[np.frombuffer(b"".join(gap + r + gap for r in raw), np.uint32)]
    owner = np.repeat(np.arange(len(raw)), np.fromiter((len(r) // 4 + 2 for r in raw), np.int64, len(raw)))
    space = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    code, owner, space = code[keep].astype(np.uint64), owner[keep], space[keep]
    has = np.bincount(owner[~space], minlength=len(raw)) > 0
    out_b, out_o = [], []
    with np.errstate(over="ignore"):
        for n in orders:
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ code[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            # A gram lies in one text; gaps stand only at its ends.
            ok = owner[n - 1 :] == owner[:m] if n > 1 else ~space
            if n == 3:
                ok = ok & ~space[1 : 1 + m]
            out_b.append((h[ok] % np.uint64(buckets)).astype(np.int64))
            out_o.append(owner[:m][ok])
    return np.concatenate(out_b) if out_b else np.zeros(0, np.int64), np.concatenate(out_o) if out_o else np.zeros(0, np.int64), has


class LanguageModel:
    def __init__(self, langs: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_prob, self.log_prior = langs, log_prob, log_prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and a score in 0..1: the posterior, its evidence evened out to 50 n-grams for longer texts."""
        clean = [blocks(t or "") for t in texts]
        owner = np.repeat(np.arange(len(clean)), [len(x) for x in clean])
        parts = [x for t in clean for x in t]
        total, n, has = np.zeros((len(clean), len(self.langs))), np.zeros(len(clean), np.int64), np.zeros(len(clean), bool)
        for rows in by_size([len(x) for x in parts], BLOCK):
            b, o, letters = grams(parts[rows], len(self.log_prob))
            order = np.argsort(o, kind="stable")
            b, o = b[order], owner[rows][o[order]]
            n += np.bincount(o, minlength=len(clean))
            has[owner[rows][letters]] = True
            for lo in range(0, len(b), 1 << 18):
                part, who = self.log_prob[b[lo : lo + (1 << 18)]], o[lo : lo + (1 << 18)]
                first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                total[who[first]] += np.add.reduceat(part, first, axis=0)
        best = (total + self.log_prior).argmax(axis=1) if self.langs else np.zeros(len(clean), int)
        known = has & bool(self.langs)
        if not self.langs:
            return [UNKNOWN] * len(clean), np.zeros(len(clean))
        even = total / np.maximum(1.0, n / 50)[:, None] + self.log_prior
        even -= even.max(axis=1, keepdims=True)
        p = np.exp(even)
        p /= p.sum(axis=1, keepdims=True)
        score = np.where(known, p[np.arange(len(clean)), best], 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)], score


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a document is kept out of the training rows: by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, buckets: int = 1 << 15, per_lang: int = 4000, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from labelled rows outside the held-out fold.

    The sample is bounded: about ``per_lang`` whole documents a language, chosen by a hash of the id, so
    training costs the same at any size.  N-gram counts are summed by Spark; one number for each language
    and bucket comes to the driver.  Rows without text or language teach nothing.
    """
    rows = docs.where(~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    u = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(u < share[F.col("lang")]).select("lang", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                texts = [x for t in part["t"] for x in blocks(t)]
                for rows in by_size([len(x) for x in texts], BLOCK):
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams(texts[rows], buckets)[0], minlength=buckets)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    counts = chosen.mapInPandas(tidy(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((buckets, len(langs)), alpha)
    table[counts["bucket"].to_numpy(int), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] += counts["n"].to_numpy(float)
    log_prob = np.log(table) - np.log(table.sum(axis=0))
    return LanguageModel(langs, log_prob, np.zeros(len(langs)))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input with lang_pred and score; ``und`` and 0 where the text is null or has no letter.

    Prediction reads the text alone, so repeated rows get equal results; languages of equal probability give
    the first by name.  Long texts are worked through in blocks cut where there is no letter.  Input columns
    named lang_pred or score are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(scored)(texts)

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            langs, scores = [], []
            t = s.tolist()
            for lo in range(0, len(t), 200):
                a, b = shared.value.predict(t[lo : lo + 200])
                langs += a
                scores += b.tolist()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    base = docs.drop("lang_pred", "score")
    name = "loomstead language"
    return base.withColumn(name, predict(F.col(text_col))).select("*", F.col(f"`{name}`.lang_pred"), F.col(f"`{name}`.score")).drop(name)
