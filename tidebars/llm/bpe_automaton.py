"""BPE as a tokenization automaton.

The automaton reads tokens. It begins with one state and an arc for each single symbol. Each merge (a, b), in order, applies a gadget:
the state that ``a`` leads to is split, its copy has no arc ``b`` (after a, b can no longer stand alone), and wherever ``a`` could be
read, ``ab`` can now be read, leading to where ``b`` led. The accepted token sequences are then exactly the encodings, one for each
word. Copies are kept as "parent without one arc", so that the whole automaton is three numbers for each merge.

Words are read symbol by symbol through the deterministic form of that automaton over symbols. Its states are sets of (automaton state,
prefix of a token being read); sets and moves are made when first met and looked up in tables afterwards. A set that stands at a token
end knows that token, so the encoding is read back along the word. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import documents, filled, kept_in_worker, map_arrow, raw, slices

#: Words, pieces and table entries that a worker remembers at most; beyond it the table concerned starts anew.
MEMO = 120_000
MOVES = 500_000
#: Symbols are numbers below this: a byte, or 256 and a byte.
SYMBOLS = 512


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges. ``encode`` takes a list of symbols (the last one marked as a word end by the caller) and gives token ids.

    Tables are arrays by token or state, or dictionaries from one packed number to another: a worker holds them beside the rest of its task.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.label = {i: t for t, i in vocab.items()}
        self.ids = max(self.label, default=-1) + 1
        made = {a + b for a, b in merges}
        self.parent, self.without, self.born = array("i", [0]), array("i", [-1]), array("i", [0])  # of states; state 0 has every arc
        self.goes = array("i", [-1]) * self.ids  # token -> state its arc leads to; -1: never read
        self.time, self.left = array("i", [0]) * self.ids, array("i", [-1]) * self.ids
        self.arcs: dict[int, bool] = {}
        for t, i in vocab.items():
            if t not in made:
                self.goes[i] = 0
        for when, (a, b) in enumerate(merges, 1):
            x, y, xy = (vocab.get(t, -1) for t in (a, b, a + b))
            if min(x, y, xy) < 0 or self.goes[x] < 0 or self.goes[y] < 0 or self.goes[xy] >= 0 or not self.has(self.goes[x], y):
                continue  # the pair never stands side by side
            self.goes[xy], self.time[xy], self.left[xy] = self.goes[y], when, x
            self.parent.append(self.goes[x])
            self.without.append(y)
            self.born.append(when)
            self.goes[x] = len(self.parent) - 1

    def has(self, state: int, token: int) -> bool:
        """Whether ``token`` can be read in ``state``."""
        known = self.arcs.get(state * self.ids + token)
        if known is None:
            s, t = state, token
            while True:
                if self.without[s] == t:
                    known = False
                elif self.time[t] < self.born[s]:
                    s = self.parent[s]
                    continue
                elif self.left[t] >= 0:
                    t = self.left[t]
                    continue
                else:
                    known = s == 0 or self.has(self.parent[s], t)
                break
            if len(self.arcs) >= MOVES:
                self.arcs.clear()
            self.arcs[state * self.ids + token] = known
        return known

    def build_tables(self, split) -> None:
        """The prefix tree of all tokens; ``split`` cuts a label into symbols (below SYMBOLS)."""
        self.size = array("i", [0]) * self.ids
        self.step: dict[int, int] = {}  # node of the tree * SYMBOLS + symbol -> node
        self.token_at, self.inner = array("i", [-1]), bytearray(1)  # of nodes: the token that ends there, and whether others go on
        for token, label in self.label.items():
            symbols = split(label)
            self.size[token] = len(symbols)
            if self.goes[token] < 0:
                continue
            at = 0
            for symbol in symbols:
                nxt = self.step.get(at * SYMBOLS + symbol)
                if nxt is None:
                    nxt = self.step[at * SYMBOLS + symbol] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.inner[at] = 1
                at = nxt
            self.token_at[at] = token
        self.reset()

    def reset(self) -> None:
        """Only the first set is known: state 0 at the root of the tree."""
        first = array("q", [0, -1]).tobytes()
        self.sets, self.number, self.last = [first], {first: 0}, array("i", [-1])
        self.moves: dict[int, int] = {}  # set number * SYMBOLS + symbol -> set number * SYMBOLS

    def move(self, state: int, symbol: int) -> int:
        """The next set of (automaton state, prefix), made when first met."""
        found, last, nodes = set(), -1, len(self.token_at)
        for member in memoryview(self.sets[state // SYMBOLS]).cast("q")[:-1]:
            at, prefix = divmod(member, nodes)
            nxt = self.step.get(prefix * SYMBOLS + symbol)
            if nxt is None:
                continue
            if self.inner[nxt]:
                found.add(at * nodes + nxt)
            token = self.token_at[nxt]
            if token >= 0 and self.has(at, token):
                found.add(self.goes[token] * nodes)
                last = token
        if not found:
            raise ValueError(f"no token goes on with symbol {symbol}")
        # different tokens may lead to one state, so the token read last belongs to a set's name
        key = array("q", [*sorted(found), last]).tobytes()
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.sets) * SYMBOLS
            self.sets.append(key)
            self.last.append(last)
        self.moves[state + symbol] = to
        return to

    def encode(self, symbols: list[int]) -> list[int]:
        """Token ids of one word; the caller marks its last symbol as a word end."""
        if len(self.moves) > MOVES:
            self.reset()
        state, met, moves = 0, [], self.moves
        for symbol in symbols:
            try:
                state = moves[state + symbol]
            except KeyError:
                state = self.move(state, symbol)
            met.append(state)
        out, i, size, last = [], len(symbols), self.size, self.last
        while i:
            token = last[met[i - 1] // SYMBOLS]
            out.append(token)
            i -= size[token]
        out.reverse()
        return out


class WordEndBpe:
    """The tokenizer of a file with word-end symbols: NFC, lower case, split by the file's pattern, bytes as symbols, merges.

    A symbol is a byte, or 256 and a byte at a word's end.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.end, self.library = path, model["end_of_word_suffix"], None
        self.of_char = {c: b for b, c in byte_symbols().items()}
        self.auto = Automaton(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self.auto.build_tables(self.symbols)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = self.auto.label | {i: t for t, i in self.special.items()}
        self.special_at = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the file's white space has no U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])"))
        # what pieces and words give: those met lately, and those of the generation before
        self.new: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}

    def symbols(self, label: str) -> list[int]:
        if label.endswith(self.end) and len(label) > len(self.end):
            out = [self.of_char[c] for c in label[: -len(self.end)]]
            out[-1] += 256
            return out
        return [self.of_char[c] for c in label]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by spaces, as a file without a decoder asks for."""
        return " ".join([self.label[i] for i in ids])

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode()

    def keep(self, key: bytes, value: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        if len(self.new) >= MEMO:
            self.old = self.new.copy()
            self.new.clear()
        self.new[key] = value
        return value

    def run(self, word: bytes) -> tuple[bytes, bytes]:
        symbols = list(word)
        symbols[-1] += 256
        return self.keep(word, self.packed(self.auto.encode(symbols)))

    def word(self, word: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text of one word of ``pre_split``, which gives itself as a piece."""
        return self.new.get(word) or self.old.get(word) or self.run(word)

    def pre_split(self, text: str) -> list[bytes]:
        """Words as bytes. Beyond the Latin blocks the library's own tables of letters and cases decide."""
        if text.isascii() or max(text) < "\u0250":
            return [w.encode() for w in self.split.findall(unicodedata.normalize("NFC", text).lower())]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        marked = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.of_char[c] for c in w]) for w, _ in marked]

    def piece(self, piece: bytes) -> tuple[bytes, bytes]:
        """Ids (little-endian, 32 bits) and decoded text of what stands between ASCII white space."""
        got = self.old.get(piece)
        if got is not None:
            return self.keep(piece, got)
        if piece.isalpha():  # ASCII letters only
            low = piece.lower()
            return self.run(low) if low == piece else self.keep(piece, self.word(low))
        text = piece.decode("utf-8", "replace")
        found, at = [], 0
        for m in self.special_at.finditer(text):
            found += [*map(self.word, self.pre_split(text[at : m.start()])), self.packed([self.special[m.group()]])]
            at = m.end()
        found += map(self.word, self.pre_split(text[at:]))
        return self.keep(piece, (b"".join([x[0] for x in found]), b" ".join([x[1] for x in found])))

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids (little-endian, 32 bits) and decoded text. Tokens never span white space, so each piece is encoded once and kept."""
        get, piece = self.new.get, self.piece
        found = [get(p) or piece(p) for p in text.split()]
        return b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[0]])


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded of every row; with ``digests`` ids_sha256 and decoded_sha256 in their place.

    Null is the empty text, with no ids and an empty decoded text. Rows with missing or repeated ids are encoded like others. An empty
    table gives no rows. Nothing is shuffled.
    """
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches):
        import numpy as np

        model = kept_in_worker(f"word_end_bpe_{path}", lambda: WordEndBpe(path))
        for part in slices(batches, "text"):
            done = [model.encode(t) for t in raw(part.column("text"))]
            if digests:
                cols = [pa.array([hashlib.sha256(x[i]).hexdigest() for x in done], pa.string()) for i in (0, 1)]
            else:
                cols = [pa.array([np.frombuffer(x[0], "<i4") for x in done], pa.list_(pa.int32())), pa.array([x[1] for x in done], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x[0]) // 4 for x in done], pa.int64()), *cols], ["doc_id", "n_tokens", *names])

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")), run, f"doc_id long, n_tokens long, {kinds}")


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)


QUERIES = {"op5_bpe_automaton": (op5_bpe_automaton, None)}
