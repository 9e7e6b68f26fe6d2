"""Byte-level BPE encoding in linear time by backtracking, and decoding through an offset table.

A sequence of tokens is the BPE encoding of its bytes exactly if every adjacent pair is: so the encoder takes the
longest token at each place (Aho-Corasick), keeps it if it is compatible with the token before, else tries the next
shorter one, and steps back where none fits; a place that led nowhere is never tried again.
The vocabulary file is a parameter; nothing of it is kept here.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the pair table and of the table of pieces at which it is emptied, so memory stays bounded.
MOST_PAIRS, MOST_PIECES, LONG_PIECE = 400_000, 350_000, 64
#: Seconds of rest after which a worker empties these tables, as it may stay alive beside the tasks of other stages.
REST = 4
#: Fixed value: the public pre-tokeniser pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A vocabulary with its merges, as tables for the encoder and the decoder."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y = raw(a), raw(b)
            pair, whole = (self.ids[x], self.ids[y]), self.ids[x + y]
            self.rank[pair] = r
            self.parts.setdefault(whole, (r, *pair))
        self.longest = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.longest.add_word(t.decode("latin-1"), (i, len(t)))
        self.longest.make_automaton()
        # the longest token that is a proper prefix of a token
        self.shorter = {i: next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t, i in self.ids.items()}
        tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.length = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            self.length[i] = len(t)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.length))), np.uint8)
        self.length_of = dict(zip(tokens, map(len, tokens.values())))
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[str, int]] = {}
        self.known: dict[str, tuple[str, int]] = {}
        self.split = regex.compile(PIECES).findall
        self.at_blank = regex.compile(r" (?=\S)").split
        self.odd_blank = regex.compile(r" (?!\S)").search
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE on both tokens' bytes leaves exactly these two: no merge over the border comes before those that made them.

        Both tokens are taken apart from their last merge back; `limit` is the rank at which the sides at the border were gone.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        limit, over = 1 << 60, True
        a, b = left, right
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                over = False
                break
            ra, rb = self.parts.get(a, (-1,))[0], self.parts.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # of equal ranks the left one was merged first, so it may still come before one at the border
                limit, a = ra, self.parts[a][2]
            else:
                limit, b = rb + 1, self.parts[b][1]
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        self.fits[key] = over
        return over

    def piece(self, text: bytes) -> list[int]:
        """The encoding of one piece: no more steps than tokens tried, each place failing once at most."""
        end, fits, length, shorter = len(text), self.fits, self.length_of, self.shorter
        best = [0] * end
        for last_at, (token, n) in self.longest.iter(text.decode("latin-1")):  # by rising end, so the longest of a start comes last
            best[last_at - n + 1] = token
        out, failed = [], set()
        at, token, last = 0, best[0], -1
        while at < end:
            while token >= 0:
                n = at + length[token]
                if n not in failed:
                    if last < 0:
                        break
                    ok = fits.get((last, token))
                    if ok or ok is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = n, token
                token = best[at] if at < end else -1
            else:
                failed.add(at)
                token = shorter[last]
                at -= length[out.pop()]
                last = out[-1] if out else -1
        return out

    def _pieces(self, part: str) -> tuple[str, int]:
        """Ids and count of a stretch of text, piece by piece; one that is a piece by itself is kept by `encode` alone."""
        pieces = self.split(part)
        if len(pieces) == 1 and part not in self.known:
            ids = self.piece(part.encode("utf-8", "surrogatepass"))
            return ",".join(map(str, ids)), len(ids)
        out, n = [], 0
        for p in pieces:
            found = self.known.get(p)
            if found is None:
                ids = self.piece(p.encode("utf-8", "surrogatepass"))
                found = (",".join(map(str, ids)), len(ids))
                if len(p) <= LONG_PIECE:
                    if len(self.known) >= MOST_PIECES:
                        self.known.clear()
                    self.known[p] = found
            out.append(found[0])
            n += found[1]
        return ",".join(out), n

    def encode(self, text: str) -> tuple[str, int]:
        """Ids joined by commas, and how many; strings of special tokens become their ids.

        A blank before a character that is none always starts a piece, so text is cut there and stretches are looked up.
        """
        self.used = time.monotonic()
        out, n, words = [], 0, self.words
        for k, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                out.append(str(self.special[part]))
                n += 1
                continue
            if not part:
                continue
            first, *rest = self.at_blank(part) if self.odd_blank(part) else part.split(" ")
            if first:
                ids, m = self._pieces(first)
                out.append(ids)
                n += m
            for w in rest:
                found = words.get(w)
                if found is None:
                    found = self._pieces(" " + w)
                    if len(w) <= LONG_PIECE:
                        if len(words) >= MOST_PIECES:
                            words.clear()
                        words[w] = found
                out.append(found[0])
                n += found[1]
        return ",".join(out), n

    def empty_at_rest(self) -> None:
        """Empties the tables of what was seen, whenever nothing has been encoded for a while."""
        while True:
            time.sleep(REST)
            if time.monotonic() - self.used > REST:
                for table in (self.fits, self.words, self.known):
                    table.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered through the offset table."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.offset[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker and vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = c = Codec(path)
        c.used = time.monotonic()
        threading.Thread(target=c.empty_at_rest, daemon=True).start()
    return _CODECS[path]


def encode_decode(documents: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every whole text, row by row without a shuffle.

    `vocabulary` is a path that every executor can read. A null text counts as empty: no tokens. Repeated rows give
    repeated results; other columns are not read; an empty table gives no rows; very long texts are encoded whole.
    """
    schema = "k string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["t"]):
                joined, n = c.encode(text or "")
                ids = np.array(joined.split(","), np.int64) if n else np.zeros(0, np.int64)
                decoded = c.decode(ids)
                if not _valid(decoded):
                    decoded = decoded.decode("utf-8", "replace").encode()
                rows.append((k, n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()) + ((ids.tolist(), decoded.decode()) if keep_ids else ()))
            yield pd.DataFrame(rows, columns=["k", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids)

    # ids go through Python as strings: pandas would round large ones where one of a batch is null
    out = documents.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, schema)
    return out.select(F.col("k").cast(documents.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def _valid(data: bytes) -> bool:
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
