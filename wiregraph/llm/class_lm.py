"""Class-based bigram language model: exchange clustering of words, then class transitions and word emissions.

Brown et al., "Class-Based n-gram Models of Natural Language" (1992), with the distributed exchange of Uszkoreit and
Brants (2008): in each round every word moves to the class that fits its neighbours' classes best under the counts of
the round before, until the likelihood of the training text stops rising. Every word has its own class and counts.

Documents are cut once into blocks of some megabytes, each with its own small vocabulary, ordered by shares of word
hashes. A share numbers its words exactly and sums their contexts over all blocks; each block gets back the numbers,
counts and classes of its own words alone, so no task and no driver holds the vocabulary of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget

BLOCK_BYTES, CLASSES = 4_000_000, 48
#: Shares of the word hashes: as many as the texts have parts of that size, but so many at least.
LEAST_SHARES, SHARE_BYTES = 128, 32_000_000
#: Letters in lower case, ASCII blanks as one of them.
PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The exchange ends with the first round that raises the likelihood by less than this, in nats a token.
RISE = 0.002
#: Weight of the unigram class distribution in transitions.
PRIOR = 24.0
#: Stands for the end of a text in vocabularies: no word holds a line end.
END = b"\n"
#: Words of a share whose contexts are dense at once.
CHUNK = 16_384
REPLY = "block string, share int, data binary"


def _pack(a: np.ndarray) -> bytes:
    """Numbers of 0 or more in the narrowest type that holds them."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    return zlib.compress(bytes([kind.itemsize]) + a.astype(kind).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    data = zlib.decompress(b)
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(kind)


def _bounds(share: np.ndarray) -> np.ndarray:
    """Where each share of a block's words begins, and the end of the last."""
    return np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1], [True]]))


def _words(data: bytes) -> pa.BinaryArray:
    """The words of bytes in which a blank follows each, with that blank."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])


def _bytes(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of words."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def _hashes(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first class) of each word, by its bytes and by its last two."""
    at, data = _bytes(words)
    size = np.diff(at)
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], at[:-1])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    last, before = data[at[1:] - 2].astype(np.int64), np.where(size > 2, data[at[1:] - 3], 0).astype(np.int64)
    return h ^ (h >> np.uint64(32)), (last * 131 + before * 7919) % CLASSES


def blocks(documents: DataFrame, id_col: str, text_col: str, shares: int) -> DataFrame:
    """One row per block: words by share with training counts and first classes, and every text as indices of words, its end included; ids as strings, which pandas cannot round."""

    def row(name: str, ids: list, held: list, texts: list[bytes]) -> pd.DataFrame:
        coded = _words(b"".join(texts)).dictionary_encode()
        token, words = coded.indices.to_numpy(), coded.dictionary
        plain = np.diff(_bytes(words)[0]) > 1  # blanks in a row give words of none
        token, words = (np.cumsum(plain) - 1)[token[plain[token]]], words.filter(pa.array(plain))
        h, first = _hashes(words)
        share = (h % np.uint64(shares)).astype(np.int32)
        order = np.argsort(share, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        end = words.index(END + b" ").as_py()
        lengths = np.diff(np.flatnonzero(token == end), prepend=-1)
        flat = rank[token]
        counts = np.bincount(flat[np.repeat(~np.array(held, bool), lengths)], minlength=len(order))
        packed = zlib.compress(_bytes(words.take(pa.array(order)))[1].tobytes(), 1)
        return pd.DataFrame({"block": [name], "words": [packed], "counts": [_pack(counts)], "shares": [_pack(share[order])], "first": [_pack(first[order])], "end": [rank[end]], "ids": [ids], "held": [held], "tokens": [_pack(flat)], "lengths": [lengths.astype(np.int32)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, out, text in zip(batch["k"], batch["held"], batch["t"]):
                texts.append((text or "").encode().translate(PLAIN) + b" " + END + b" ")
                ids.append(i)
                held.append(bool(out))
                size += len(texts[-1]) + 50
                if size >= BLOCK_BYTES:
                    yield row(f"{part}-{k}", ids, held, texts)
                    k, ids, held, texts, size = k + 1, [], [], [], 0
        if ids:
            yield row(f"{part}-{k}", ids, held, texts)

    is_held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    schema = "block string, words binary, counts binary, shares binary, first binary, end int, ids array<string>, held array<boolean>, tokens binary, lengths array<int>"
    return documents.select(F.col(id_col).cast("string").alias("k"), is_held.alias("held"), F.col(text_col).alias("t")).mapInPandas(run, schema)


def _replies(df: DataFrame, name: str) -> DataFrame:
    """(block, `name`): what the shares send to a block, in the order of its words."""
    return df.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("share", "data")))["data"].alias(name))


def numbered(cut: DataFrame) -> DataFrame:
    """The blocks with, instead of words, their exact numbers within the share, corpus counts, and whether the block is the word's first."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                words, counts, share = _words(zlib.decompress(row.words)), _unpack(row.counts, np.int32), _unpack(row.shares, np.int32)
                at = _bounds(share)
                yield pd.DataFrame([(row.block, int(share[a]), zlib.compress(_bytes(words[a:b])[1].tobytes(), 1), counts[a:b].tobytes()) for a, b in zip(at, at[1:])], columns=["block", "share", "words", "counts"])

    def number(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [zlib.decompress(w) for w in group["words"]]
        counts = [np.frombuffer(n, np.int32) for n in group["counts"]]
        at = _words(b"".join(parts)).dictionary_encode().indices.to_numpy().astype(np.int64)
        own = at > np.concatenate([[-1], np.maximum.accumulate(at)[:-1]])  # numbers rise where words first occur
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        cuts = np.cumsum([len(c) for c in counts])[:-1]
        return pd.DataFrame({"block": group["block"], "share": key[0], "data": [_pack(np.concatenate([a, total[a], o.astype(np.int64)])) for a, o in zip(np.split(at, cuts), np.split(own, cuts))]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[_unpack(d, np.int64).reshape(3, -1) for d in row] for row in batch["reply"]]
            at, c, own = ([np.concatenate([p[i] for p in row]) for row in parts] for i in range(3))
            yield pd.DataFrame({"block": batch["block"], "at": [_pack(a) for a in at], "c": [_pack(x) for x in c], "own": [_pack(o) for o in own]})

    sent = cut.select("block", "words", "counts", "shares").mapInPandas(spread, "block string, share int, words binary, counts binary")
    replies = _replies(sent.groupBy("share").applyInPandas(number, REPLY), "reply").mapInPandas(join, "block string, at binary, c binary, own binary")
    return cut.drop("words", "counts").join(replies, "block")


def _contexts(x: DataFrame) -> DataFrame:
    """Per block and share, (share, block, classes, at, keys, counts): its words' counts with the classes before and after them; as (cell, n): counts of class pairs, then tokens and words seen once and words seen of each class."""
    k2 = 2 * CLASSES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(CLASSES * CLASSES + 3 * CLASSES, np.int64)
        for batch in batches:
            for row in batch.itertuples():
                cls = np.concatenate([_unpack(d, np.uint8) for d in row.classes])
                at, c, own, share = _unpack(row.at, np.int32), _unpack(row.c, np.int64), _unpack(row.own, bool), _unpack(row.shares, np.int32)
                for i, n in enumerate((c, c == 1, c > 0)):
                    cells[CLASSES * (CLASSES + i) : CLASSES * (CLASSES + i + 1)] += np.bincount(cls[own], n[own], CLASSES).astype(np.int64)
                t = _unpack(row.tokens, np.uint32)[np.repeat(~np.asarray(row.held, bool), np.asarray(row.lengths))]
                k = cls[t].astype(np.uint32)
                before = np.concatenate([cls[[row.end]], k[:-1]]).astype(np.uint32) if len(k) else k
                cells[: CLASSES * CLASSES] += np.bincount(before * CLASSES + k, minlength=CLASSES * CLASSES)
                t *= np.uint32(k2)  # a block has far fewer than 2^32 / k2 words
                key = np.concatenate([t + before, t[:-1] + np.uint32(CLASSES) + k[1:]])
                key.sort()
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
                key, n = key[first], np.diff(np.append(first, len(key))).astype(np.uint32)
                ends = _bounds(share)
                cuts = np.searchsorted(key, (ends * k2).astype(np.uint32))
                rows = [(int(share[a]), row.block, _pack(cls[a:b]), _pack(at[a:b]), _pack(np.diff(key[p:q], prepend=key.dtype.type(a * k2))), _pack(n[p:q]), None, None) for a, b, p, q in zip(ends, ends[1:], cuts, cuts[1:])]
                yield pd.DataFrame(rows, columns=["share", "block", "classes", "at", "keys", "counts", "cell", "n"])
        some = np.flatnonzero(cells)
        yield pd.DataFrame({"share": [None] * len(some), "block": None, "classes": None, "at": None, "keys": None, "counts": None, "cell": some, "n": cells[some]})

    return x.mapInPandas(run, "share int, block string, classes binary, at binary, keys binary, counts binary, cell int, n long")


def _cells(contexts: DataFrame) -> np.ndarray:
    """Counts of class pairs, and three rows more: tokens, words seen once and words seen of each class."""
    out = np.zeros(CLASSES * (CLASSES + 3))
    for r in contexts.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(CLASSES + 3, CLASSES)


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the training tokens by class, up to the words' own entropy, which no class changes."""
    expected = np.outer(pairs.sum(1), pairs.sum(0))
    some = pairs > 0
    return float((pairs[some] * np.log(pairs[some] / expected[some])).sum())


def move(contexts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """One round: every word to the class with the largest likelihood of its neighbours' classes; it stays in equal ones and if unseen."""
    n = pairs + 0.1
    gain = np.log(n * n.sum() / (n.sum(1, keepdims=True) * n.sum(0, keepdims=True)))
    both = np.concatenate([gain, gain.T])
    k2 = 2 * CLASSES

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = [_unpack(a, np.int32).astype(np.int64) for a in group["at"]]
        cls = np.zeros(max(int(a.max()) for a in found) + 1, np.uint8)
        keys, counts = [], []
        for at, c, k, n in zip(found, group["classes"], group["keys"], group["counts"]):
            cls[at] = _unpack(c, np.uint8)
            k = np.cumsum(_unpack(k, np.int32), dtype=np.int64)
            keys.append(at[k // k2] * k2 + k % k2)
            counts.append(_unpack(n, np.float64))
        k, n = np.concatenate(keys), np.concatenate(counts)
        if len(cls) > CHUNK:
            order = np.argsort(k)
            k, n = k[order], n[order]
        for a in range(0, len(cls), CHUNK):
            old = cls[a : a + CHUNK]
            p, q = np.searchsorted(k, [a * k2, (a + len(old)) * k2]) if len(cls) > CHUNK else (0, len(k))
            fit = np.bincount(k[p:q] - a * k2, n[p:q], len(old) * k2).reshape(-1, k2) @ both
            best, rows = fit.argmax(1), np.arange(len(old))
            cls[a : a + CHUNK] = np.where(fit[rows, best] > fit[rows, old] + 1e-9, best, old)
        return pd.DataFrame({"block": group["block"], "share": key[0], "data": [_pack(cls[a]) for a in found]})

    return contexts.where("share is not null").drop("cell", "n").groupBy("share").applyInPandas(run, REPLY)


def exchange(cut: DataFrame, rounds: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(block and classes of its words, counts by class as in `_cells`) when the likelihood rises by less than RISE, or after `rounds`."""
    used = cut.select("block", "at", "c", "own", "shares", "tokens", "held", "lengths", "end")
    state, kept, before, k = cut.select("block", F.array("first").alias("classes")), None, 0.0, 0
    while True:
        contexts = durable(_contexts(used.join(state, "block")))
        cells = _cells(contexts)
        now, tokens = likelihood(cells[:CLASSES]), cells[CLASSES].sum()
        if kept is None or now > before:
            last, kept = kept, (state, cells)
        else:
            last = (state, None)
        if last and k > 1:
            forget(last[0])
        done = not tokens or k == rounds or (k > 0 and now - before < RISE * tokens)
        if not done:
            state = durable(_replies(move(contexts, cells[:CLASSES]), "classes"))
        forget(contexts)
        cut.sparkSession._jvm.System.gc()  # lets Spark drop the shuffles of the round
        if done:
            return kept
        before, k = now, k + 1


def score(documents: DataFrame, *, id_col="doc_id", text_col="text", rounds: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A token's probability is P(its class | class before) times its share of the class; a share u of each class, estimated
    from words seen once (Good-Turing), is left to unknown words. A null text counts as empty: its end alone. A null id
    is trained on. Repeated rows count each; very long texts are scored whole; no other column is read. Without training tokens all words are unknown; an empty table gives no rows.
    `rounds` ends the exchange early; without it, the likelihood does.
    """
    texts_bytes = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    raw = durable(blocks(documents, id_col, text_col, max(LEAST_SHARES, 1 << (texts_bytes // SHARE_BYTES).bit_length())))
    cut = durable(numbered(raw))
    forget(raw)
    classes, cells = exchange(cut, rounds)
    pairs, (size, once, seen) = cells[:CLASSES], cells[CLASSES:]
    tokens, kinds = int(size.sum()), int(seen.sum())
    unigram = (size + 0.5) / (size + 0.5).sum()
    step = np.log10((pairs + PRIOR * unigram) / (pairs.sum(1, keepdims=True) + PRIOR))
    unknown = (once + 0.5) / (size + 1.0)
    model = (step, np.log10(unknown), np.log10(1 - unknown) - np.log10(np.maximum(size, 1)))
    kind = documents.schema[id_col].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, no, yes = model
        for batch in batches:
            for row in batch.itertuples():
                c, token, lengths = _unpack(row.c, np.int64), _unpack(row.tokens, np.int32), np.asarray(row.lengths)
                k = np.concatenate([_unpack(d, np.uint8) for d in row.classes]).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                own = np.where(c > 0, np.log10(np.maximum(c, 1)) + yes[k], no[k])
                kt = k[token]
                before = np.empty_like(kt)
                before[1:] = kt[:-1]
                before[starts] = k[row.end]
                total = np.add.reduceat(step[before, kt] + own[token], starts)
                base = np.add.reduceat(np.log10((c + 1) / (tokens + kinds + 1))[token], starts)
                known = np.add.reduceat((c > 0).astype(np.int64)[token], starts)
                yield pd.DataFrame({"k": list(row.ids), "held_out": list(row.held), "n_tokens": lengths.astype(np.int64), "n_known": known, "train_tokens": np.int64(tokens), "base_score": base, "score": total})

    joined = cut.join(classes, "block").select("tokens", "lengths", "ids", "held", "end", "c", "classes")
    scored = joined.mapInPandas(run, "k string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.col("k").cast(kind).alias(id_col), *scored.columns[1:])


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) per token."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
