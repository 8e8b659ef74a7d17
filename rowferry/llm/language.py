"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, which a forward algorithm adds up; a text's is the
product over its words. The pieces' probabilities are trained here, by expected counts over all
segmentations of labelled words; the vocabulary is not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rowferry.llm.common import unused, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
#: The mark that opens a word in the vocabulary's pieces.
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Probability of a character that is no piece, and the count every piece has before any is seen.
STRAY, PRIOR_COUNT = 1e-7, 0.05
#: Words of up to 64 characters scored at a time (of longer ones fewer), and scores of words that a task remembers.
AT_ONCE, REMEMBERED = 8192, 200_000


def text_words(text: str | None) -> list[str]:
    """Lowered runs of letters."""
    return WORD.findall(text.lower()) if text else []


def _codes(words: list[str]) -> np.ndarray:
    """[word, position] code points of words of one length, each opened by the mark."""
    return np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"),
                         np.uint32).reshape(len(words), -1).astype(np.uint64)


class Pieces:
    """The letters-only, lower-case pieces of a vocabulary, found by a hash of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size())}
        names = sorted(n for n in names if n == START or (b := n.removeprefix(START)).isalpha() and b == b.lower())
        self.longest = max(map(len, names))
        hashes = []
        for name in names:
            h = 0
            for c in name:
                h = (h * int(PRIME) + ord(c) + 1) % (1 << 64)
            hashes.append(h)
        self.hashes = np.sort(np.array(hashes, np.uint64))
        self.count = len(self.hashes)

    def ids(self, codes: np.ndarray) -> list[np.ndarray]:
        """[length - 1][word, start]: the piece of that length there; ``count``: a character that is
        no piece; ``count + 1``: nothing."""
        words, n = codes.shape
        out, running = [], np.zeros((words, n), np.uint64)
        for length in range(1, min(n, self.longest) + 1):
            width = n - length + 1
            running = running[:, :width] * PRIME + codes[:, length - 1:] + np.uint64(1)
            at = np.searchsorted(self.hashes, running)
            known = self.hashes[np.minimum(at, self.count - 1)] == running
            out.append(np.where(known, at, self.count if length == 1 else self.count + 1).astype(np.int32))
        return out


def forward(ids: list[np.ndarray], chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, log): summed probabilities of all segmentations up to each position, and the logarithm
    of the whole word's. chance: [piece, language]. alpha [word, position, language] is rescaled
    every 16 positions, so words of any length can be scored; only unscaled ones have ``log`` equal
    to the logarithm of the last alpha."""
    words, n = ids[0].shape
    alpha = np.zeros((words, n + 1, chance.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros((words, chance.shape[1]))
    for end in range(1, n + 1):
        for length in range(1, min(end, len(ids)) + 1):
            alpha[:, end] += alpha[:, end - length] * chance[ids[length - 1][:, end - length]]
        if end % 16 == 0 and end > 32:
            low = max(0, end + 1 - len(ids))
            top = np.maximum(alpha[:, low:end + 1].max(axis=1), 1e-300)
            alpha[:, low:end + 1] /= top[:, None]
            scale += np.log(top)
    return alpha, np.log(np.maximum(alpha[:, n], 1e-300)) + scale


def _rescaled(values: np.ndarray, logs: np.ndarray, part: slice) -> None:
    """Divide the positions ``part`` by their greatest value and add its logarithm to theirs."""
    top = np.maximum(values[:, part].max(axis=1), 1e-300)[:, None]
    values[:, part] /= top
    logs[:, part] += np.log(top)


def expected(ids: list[np.ndarray], chance: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected counts of pieces over all segmentations of words seen ``times`` times (one language).
    Sums from both ends are rescaled every 16 positions, with a logarithm for each, so words have any length."""
    words, n = ids[0].shape
    alpha, beta = np.zeros((words, n + 1)), np.zeros((words, n + 1))
    ahead, behind = np.zeros((words, n + 1)), np.zeros((words, n + 1))
    alpha[:, 0] = beta[:, n] = 1
    for end in range(1, n + 1):
        ahead[:, end] = ahead[:, end - 1]
        for length in range(1, min(end, len(ids)) + 1):
            alpha[:, end] += alpha[:, end - length] * chance[ids[length - 1][:, end - length]]
        if end % 16 == 0:
            _rescaled(alpha, ahead, slice(max(0, end + 1 - len(ids)), end + 1))
    for start in range(n - 1, -1, -1):
        behind[:, start] = behind[:, start + 1]
        for length in range(1, min(n - start, len(ids)) + 1):
            beta[:, start] += chance[ids[length - 1][:, start]] * beta[:, start + length]
        if start % 16 == 0:
            _rescaled(beta, behind, slice(start, min(n, start + len(ids) - 1) + 1))
    whole = np.log(np.maximum(beta[:, 0], 1e-300)) + behind[:, 0]
    counts = np.zeros(len(chance))
    for length, found in enumerate(ids, 1):
        width = n - length + 1
        scale = np.exp(ahead[:, :width] + behind[:, length:length + width] - whole[:, None])
        share = alpha[:, :width] * chance[found] * beta[:, length:length + width] * scale * times[:, None]
        counts += np.bincount(found.ravel(), share.ravel(), len(chance))
    return counts


@dataclass
class Model:
    """Languages and their probabilities of pieces; the last two rows are strays and nothing."""

    languages: list[str]
    pieces: Pieces
    chance: np.ndarray

    def log_chances(self, words: list[str]) -> np.ndarray:
        """[word, language] logarithms; words without a letter have 0 in all."""
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if any(map(str.isalpha, w)):
                by_length.setdefault(len(w), []).append(i)
        for length, some in by_length.items():
            step = max(1, AT_ONCE * 64 // max(length, 64))
            for at in range(0, len(some), step):
                part = some[at:at + step]
                out[part] = forward(self.pieces.ids(_codes([words[i] for i in part])), self.chance)[1]
        return out

    def predict(self, texts: list[str | None], memory: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text, all being equally likely before, and its
        probability; ``und`` and 0 for texts without a letter."""
        languages, scores = [], np.zeros(len(texts))
        found = [Counter(text_words(t)) for t in texts]
        new = list({w for words in found for w in words if w not in memory})
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = list({w for words in found for w in words})
        memory.update(zip(new, self.log_chances(new)))
        for i, words in enumerate(found):
            total = np.zeros(len(self.languages))
            if words:
                total = np.array(list(words.values()), float) @ np.array([memory[w] for w in words])
            if not total.any() or not self.languages:
                languages.append(UNKNOWN)
                continue
            best = int(total.argmax())
            languages.append(self.languages[best])
            scores[i] = 1 / np.exp(total - total[best]).sum()
        return languages, scores


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string")) % 5 == 0


def train(labelled: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang",
          vocabulary: str = VOCABULARY, train_rows: int = 3000, rounds: int = 3) -> Model:
    """A model from rows with a language.

    Of each language about ``train_rows`` rows are used (all, if it has no more), chosen by a hash of
    the id: the stated bound of the sample. Their words are counted on Spark. Each round sums expected
    counts of pieces by language on Spark; the driver gets one number per piece and language, bounded
    by the vocabulary. Rows without text or language are not used. No rows give a model without
    languages, which predicts ``und``.
    """
    spark = labelled.sparkSession
    known = (labelled.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
             .where("lang is not null and text is not null"))
    counts = known.groupBy("lang").count().collect()  # one row for each language, as the model has
    luck = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], train_rows / r["count"])])
    sample = known.where(luck < share[F.col("lang")]) if counts else known

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for language, content in zip(batch["lang"], batch["text"]):
                counts.update((language, w) for w in text_words(content))
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "word", "n"])

    words = written(sample.mapInPandas(count, "lang string, word string, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    pieces = Pieces(vocabulary)
    chance = np.full((pieces.count + 2, len(languages)), 1.0 / pieces.count)
    chance[-2], chance[-1] = STRAY, 0
    model = Model(languages, pieces, chance)
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = shared.value
            sums = np.zeros_like(now.chance)
            for batch in batches:
                for (language, _), rows in batch.groupby(["lang", batch["word"].str.len()]):
                    at = now.languages.index(language)
                    step = max(1, AT_ONCE * 64 // max(len(rows["word"].iloc[0]), 64))
                    for k in range(0, len(rows), step):
                        part = rows.iloc[k:k + step]
                        sums[:, at] += expected(now.pieces.ids(_codes(list(part["word"]))), now.chance[:, at],
                                                part["n"].to_numpy(float))
            piece, at = np.nonzero(sums)
            yield pd.DataFrame({"piece": piece, "at": at, "n": sums[piece, at]})

        sums = (words.mapInPandas(expect, "piece long, at long, n double")
                .groupBy("piece", "at").agg(F.sum("n").alias("n")).toPandas())
        counts = np.full((pieces.count, len(languages)), PRIOR_COUNT)
        seen = sums[sums["piece"] < pieces.count]
        counts[seen["piece"], seen["at"]] += seen["n"]
        chance = np.vstack([counts / counts.sum(axis=0), np.full(len(languages), STRAY), np.zeros(len(languages))])
        model = Model(languages, pieces, chance)
        shared.unpersist()
    return model


def languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and score, which replace columns of these names.

    A text that is NULL or has no letter gets ``und`` and score 0. Whole texts are scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = [shared.value.predict(list(batch[k:k + 1000]), memory) for k in range(0, len(batch), 1000)]
            yield pd.DataFrame({"lang_pred": [x for names, _ in parts for x in names],
                                "score": np.concatenate([s for _, s in parts]) if parts else np.zeros(0)})

    found = unused(docs, "found")
    return (docs.withColumn(found, predicted(F.col(text)))
            .withColumns({"lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(found))


def identified(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: learned from the rows whose id's checksum
    is not divisible by 5, applied to all. Repeated rows come back as often as given, NULL ids are in
    the training part; an empty table gives no rows; other columns are not used."""
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    model = train(rows.where(~F.col("held_out")), **settings)
    return languages(rows, model).select("doc_id", "held_out", "lang_pred", "score")
