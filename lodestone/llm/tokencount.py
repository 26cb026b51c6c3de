"""Token counts by the whole-token shortcut.

A text falls into pre-tokens that no merge can cross. The shortcut first proves which strings of the
vocabulary come out of the tokenizer as one token when they stand alone; a pre-token that is such a
string counts 1 without any merging. Only the rest is merged, by the tokenizer's own library, once
for each different pre-token that a worker meets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from lodestone.llm.common import map_rows

#: Merged pre-tokens a worker remembers; beyond it the memory starts anew. Counts don't depend on it.
REMEMBERED = 1_000_000
_PIECES = re.compile(" +[^ ]*|[^ ]+")
_WORDS = re.compile(r"(?<=\S)(?= \S)")


class PieceCounter:
    """Counts of a SentencePiece model whose pieces carry their word mark only in front.

    Pre-tokens: a run of spaces with what follows up to the next space, and what stands behind a
    line feed, where no piece holds a line feed. Both facts are checked on the vocabulary; if one
    fails, whole texts go to the library.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.front_only = all("▁" not in p.lstrip("▁") for p in plain)
        self.divides = self.front_only and not any("\n" in p for p in plain) and self._size("\n") == [2]
        spaced = [p[1:] for p in plain if p[:1] == "▁" and "▁" not in p[1:]]
        bare = [p for p in plain if "▁" not in p]
        self.whole = {p for p, n in zip(spaced, self._size(*spaced)) if n == 1}
        self.whole_bare = {p for p, n in zip(bare, self._size(*("\n" + p for p in bare))) if n == 3}
        self.forget()

    def forget(self) -> None:
        self.spaced, self.bare = dict.fromkeys(self.whole, 1), dict.fromkeys(self.whole_bare, 1)
        self.spaced[""] = 1  # a space that nothing follows: the mark alone

    def _size(self, *texts: str) -> list[int]:
        return [len(x) for x in self.sp.encode(list(texts), num_threads=1)]

    def _learn(self, spaced: set[str], bare: set[str]) -> None:
        if len(self.spaced) + len(self.bare) > REMEMBERED:
            keep_s, keep_b = {k: self.spaced[k] for k in spaced if k in self.spaced}, {k: self.bare[k] for k in bare if k in self.bare}
            self.forget()
            self.spaced.update(keep_s)
            self.bare.update(keep_b)
        new = [k for k in spaced if k not in self.spaced]
        self.spaced.update(zip(new, self._size(*new)) if new else ())
        new = [k for k in bare if k not in self.bare]  # a line feed takes the mark that the library puts in front
        self.bare.update(zip(new, (n - 2 for n in self._size(*("\n" + k for k in new)))) if new else ())

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.divides:
            return [n if t else 0 for t, n in zip(texts, self._size(*(t or "" for t in texts)))]
        out = []
        for t in texts:
            if not t:
                out.append(0)
                continue
            first, *lines = t.replace("▁", " ").split("\n")
            spaced, bare = [], []
            self._divide(" " + first, spaced, bare)
            for line in lines:
                if line:
                    self._divide(line, spaced, bare)
            try:
                n = sum(map(self.spaced.__getitem__, spaced)) + sum(map(self.bare.__getitem__, bare))
            except KeyError:
                self._learn(set(spaced), set(bare))
                n = sum(map(self.spaced.__getitem__, spaced)) + sum(map(self.bare.__getitem__, bare))
            out.append(n + len(lines))
        return out

    @staticmethod
    def _divide(line: str, spaced: list[str], bare: list[str]) -> None:
        """Keys lack the first of their spaces."""
        if "  " in line:
            for x in _PIECES.findall(line):
                (spaced.append(x[1:]) if x[0] == " " else bare.append(x))
            return
        head, *rest = line.split(" ")
        if head:
            bare.append(head)
        spaced += rest


class WordCounter:
    """Counts of a tokenizers file whose pre-tokens never join what stands on both sides of a single space.

    Pre-tokens are taken in stretches from one single space to the next. A text with a special
    string, and any text if the tokenizer normalises or its splitter isn't byte-level, goes to the
    library whole.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        pre = known.get("pre_tokenizer") or {}
        self.divides = not known.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not known.get("truncation") and not known.get("padding")
        self.special = [t["content"] for t in known.get("added_tokens", [])]
        self.whole: dict[str, int] = {}
        if self.divides:
            strings = [s for s in self.tok.decode_batch([[i] for i in range(self.tok.get_vocab_size())], skip_special_tokens=False) if s not in self.special]
            self.whole = {s: 1 for s, n in zip(strings, self._size(strings)) if n == 1}
        self.known = dict(self.whole)

    def _size(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: list[str | None]) -> list[int]:
        out = []
        for t in texts:
            t = t or ""
            if not self.divides or any(s in t for s in self.special):
                out.append(self._size([t])[0])
                continue
            parts = _WORDS.split(t)
            new = list({p for p in parts if p not in self.known})
            if new:
                if len(self.known) > REMEMBERED:
                    self.known = dict(self.whole)
                    new = list({p for p in parts if p not in self.known})
                self.known.update(zip(new, self._size(new)))
            out.append(sum(map(self.known.__getitem__, parts)))
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | WordCounter:
    """The counter for a file, once for each worker."""
    return PieceCounter(path) if path.endswith(".model") else WordCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, by the tokenizer file at `tokenizer`.

    n_tokens is what the file's library returns for the whole text without begin, end or added
    special tokens. Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay;
    other columns are ignored; an empty table gives no rows. No shuffle.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        c = counter(tokenizer)
        for b in batches:
            n = c.counts(b["text"])
            yield {"doc_id": b["doc_id"], "n_bytes": [len((t or "").encode()) for t in b["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows, 256)
