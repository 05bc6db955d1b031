"""Exact merge-type piece encoding by backtracking.

A sequence of pieces is the one that greedy merging would produce exactly when each pair of neighbours
is: merges inside a stretch do not depend on what lies outside as long as none crosses its ends. So the
encoder walks left to right, takes the longest vocabulary match (found for all positions by one
Aho-Corasick pass), accepts it if re-merging it with its left neighbour gives just these two, otherwise
tries the next shorter prefix, and steps back when none is left. A bitfield marks positions from which
no encoding went on, so none is tried twice.

Texts are cut only where no piece of the vocabulary can reach across: before a space mark that follows
another character, and around characters that occur in no piece. Encodings of these short stretches
are kept in a bounded cache, as words repeat.

Null text counts as empty (no ids). Repeated rows give repeated results.
"""

import functools
import hashlib
import heapq
import re

import ahocorasick
from pyspark.sql import DataFrame

from rasterlab.llm.common import in_batches, pick

SPACE = "▁"
CACHE_WORDS = 400_000  # cached words of each half of a worker's cache
CACHED_CHARS = 64      # longer words are encoded but not kept
PAIRS = 400_000        # remembered pair checks


class PieceEncoder:
    """Encoder and decoder over the pieces and scores of a merge-type model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id, self.bytes_of, self.piece, self.score, self.ident = {}, {}, {}, {}, {}
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.piece[i], self.score[p], self.ident[p] = p, sp.get_score(i), i
        alphabet = {c for p in self.score for c in p}
        # characters that only occur inside longer pieces still take part in merges
        for c in alphabet - set(self.score):
            self.ident[c] = -ord(c)
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.score)
        known = "".join(re.escape(c) for c in sorted(alphabet - {SPACE}))
        self.stretches = re.compile(
            f"[{known}{SPACE}]+|[^{known}{SPACE}]" if self.whole else f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]", re.S)
        self.alphabet = alphabet
        self.matches = ahocorasick.Automaton()
        for p in self.ident:
            self.matches.add_word(p, p)
        self.matches.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.shown = {p: (str(i), p.replace(SPACE, " ")) for i, p in self.piece.items()}

    def merged(self, s: str) -> list[str]:
        """Greedy merging: the best-scored neighbours first, the leftmost of equals."""
        sym, right, left = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = []

        def offer(i):
            j = right[i]
            if j < len(s) and (x := self.score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-x, i, j, sym[i] + sym[j]))
        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not sym[i] or not sym[j] or right[i] != j or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            right[i] = right[j]
            if right[i] < len(s):
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in sym if x]

    def _pair(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stand side by side after merging both together."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        got = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def _shorter(self, p: str) -> str:
        """The next shorter piece that ``p`` starts with, or nothing."""
        got = self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ident), "")
        return got

    def backtrack(self, s: str) -> list[str]:
        """The pieces of a stretch of known characters."""
        longest = [""] * len(s)  # a position without a match ends in an IndexError below
        for end, p in self.matches.iter(s):
            longest[end - len(p) + 1] = p  # later ends are longer
        out: list[str] = []
        failed = bytearray(len(s) // 8 + 1)
        pairs, shorter, last, pos, p = self.pairs, self.shorter, "", 0, longest[0]
        while True:
            end = pos + len(p)
            if end > pos and not failed[end >> 3] >> (end & 7) & 1:
                fits = pairs.get((last, p))
                if self._pair(last, p) if fits is None else fits:
                    out.append(p)
                    if end == len(s):
                        return out
                    last, pos, p = p, end, longest[end]
                    continue
            if not p:
                raise IndexError(f"no piece at {pos}")
            short = shorter.get(p)
            if short := self._shorter(p) if short is None else short:
                p = short
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                p = out.pop()
                pos -= len(p)
                last = out[-1] if out else ""

    def stretch_ids(self, s: str) -> list[int]:
        if s[0] not in self.alphabet:
            return [self.byte_id[b] for b in s.encode()]
        ids = []
        for p in self.backtrack(s):
            i = self.ident[p]
            ids += [i] if i >= 0 else [self.byte_id[b] for b in p.encode()]
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for s in self._cut(text) for i in self.stretch_ids(s)]

    def _cut(self, text: str) -> list[str]:
        return self.stretches.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int], inner: bool = False) -> str:
        """Text of ids: space marks become spaces, byte runs are read as UTF-8.

        The space that encoding put in front is dropped, unless ``inner`` says
        that these ids do not start the sequence.
        """
        raw = b"".join([self.bytes_of[i] if i in self.bytes_of else self.piece[i].encode() for i in ids
                        if i in self.bytes_of or i in self.piece])
        text = raw.decode("utf-8", errors="replace").replace(SPACE, " ")
        return text[1:] if not inner and text.startswith(" ") else text

    def _kept(self, word: str) -> tuple[int, str, str]:
        """Encode a word, or take it from the older half of the cache."""
        got = self.old.get(word)
        if got is None:
            try:
                plain = [self.shown[p] for p in self.backtrack(word)]
                got = len(plain), ",".join([p[0] for p in plain]), "".join([p[1] for p in plain])
            except (KeyError, IndexError):  # characters that become bytes
                ids = [i for s in self.stretches.findall(word) for i in self.stretch_ids(s)]
                got = len(ids), ",".join(map(str, ids)), self.decode(ids, inner=True)
        if len(word) <= CACHED_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def _words(self, text: str) -> list[str]:
        """The text in parts that no piece reaches across, long enough to repeat."""
        marked = SPACE + text.replace(" ", SPACE)
        if self.whole or "\n" in self.alphabet:
            return self._cut(text)
        out = []
        for line in marked.split("\n"):
            if SPACE + SPACE in line or line[-1:] == SPACE:
                out += self.stretches.findall(line)
            else:
                first, *rest = line.split(SPACE)
                if first:
                    out.append(first)
                out += [SPACE + w for w in rest]
            out.append("\n")
        return out[:-1]

    def digest_parts(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and the decoded text."""
        if not text:
            return 0, "", ""
        parts = []
        for w in self._words(text):
            got = self.young.get(w)
            parts.append(self._kept(w) if got is None else got)
        decoded = "".join([p[2] for p in parts])
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), decoded[1:] if decoded[:1] == " " else decoded


@functools.lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the ids and the text that decoding gives back."""
    def run(keys, texts):
        e = encoder(path)
        ids = [e.encode(t or "") for t in texts]
        return {key: keys, "ids": ids, "decoded": [e.decode(x) for x in ids]}
    return in_batches(pick(docs, **{key: "long", text: "string"}), run, f"{key} long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the decoded text."""
    def run(keys, texts):
        e = encoder(path)
        out = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            n, ids, decoded = e.digest_parts(t or "")
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out
    return in_batches(pick(docs, doc_id="long", text="string"), run,
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
