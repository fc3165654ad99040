"""Public tokenizers cut into independent pre-tokens, so that each distinct one is encoded once.

A vocabulary splits a text into pre-tokens across which no merge can happen; the tokens of the text
are those of its pre-tokens, one after the other. Files are read by the driver and sent as bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

# Above this many characters a text is cut lazily, so that its pre-tokens are never held at once.
LONG = 1 << 20
# Parts of such characters are letters, numbers, marks or white space by every version of Unicode.
SETTLED = re.compile("[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0523\u2010-\u2026]*")
# How the byte-level pre-tokenizer cuts a text (fixed value of such vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that some Unicode version counts as white space, or that are often taken for it.
WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def default_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(pattern: re.Pattern, text: str) -> Iterable[str]:
    if len(text) <= LONG:
        return filter(None, pattern.findall(text))
    return (m.group() for m in pattern.finditer(text) if m.end() > m.start())


class ByteLevel:
    """Byte-level BPE of a ``.json`` file, with the ids that the tokenizers library gives.

    Its pre-tokenizer never joins white space to what stands before it. So a text may be cut before
    each plain space that follows a character which is certainly not white space. Where the ids of
    the file follow its merges, parts of settled characters are encoded by tiktoken with the file's
    own tokens as ranks, several times faster and to the same ids; all others by tokenizers itself.
    """

    _cut = re.compile(f" *[^ ]*(?:(?<=[{WHITE}]) +[^ ]*)*")

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        spec = json.loads(raw)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without a normalizer or an added space")
        self._tokenizer = Tokenizer.from_str(raw.decode())
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._ranked = None
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        special = {token["content"] for token in spec.get("added_tokens", ())}
        if made == sorted(made) and not special & vocab.keys():
            import tiktoken

            known = self.token_bytes()
            ranks = {known[i]: i for token, i in vocab.items()}
            self._ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def split(self, text: str) -> Iterable[str]:
        return _cuts(self._cut, text)

    def encode(self, parts: list[str]) -> list[list[int]]:
        if self._ranked is None:
            return self._by_library(parts)
        ranked, settled = self._ranked.encode_ordinary, SETTLED.fullmatch
        found = [ranked(part) if settled(part) else None for part in parts]
        others = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(others, self._by_library([parts[i] for i in others]), strict=True):
            found[i] = ids
        return found

    def _by_library(self, parts: list[str]) -> list[list[int]]:
        found = self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [one.ids for one in found]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; bytes are written as printable characters in the file."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab = self._tokenizer.get_vocab()
        found = [b""] * (max(vocab.values()) + 1)
        for token, number in vocab.items():
            found[number] = bytes(byte[c] for c in token) if set(token) <= byte.keys() else token.encode()
        return found


class Pieces:
    """BPE pieces of a ``.model`` file, encoded by the sentencepiece library.

    A space is U+2581 inside, and one stands before every text. In a piece, U+2581 only stands in
    front, and some characters (digits, line ends) are in no longer piece at all. So pre-tokens are
    words with the spaces before them, runs of spaces, and single characters that never merge.
    """

    ANCHOR = "\n"  # merges with nothing: what follows it is encoded as in the middle of a text
    SPACE = "\u2581"

    def __init__(self, raw: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        ids = range(self._model.vocab_size())
        pieces = [p for p in map(self._model.id_to_piece, (
            i for i in ids if not (self._model.is_byte(i) or self._model.is_control(i) or self._model.is_unknown(i))
        )) if len(p) > 1]
        joining = {c for p in pieces for c in p} - {self.SPACE}
        inner = [p for p in pieces if self.SPACE in p.lstrip(self.SPACE)]
        self._lead = len(self._model.encode(self.ANCHOR))
        probe = "a  b ﬁ c "
        changed = self._model.decode(self._model.encode(probe)) != probe
        if inner or changed or self.ANCHOR in joining or " " in joining:
            raise ValueError("only vocabularies without a normalizer, whose pieces hold spaces in front alone")
        kind = "".join(map(re.escape, sorted(joining)))
        self._cut = re.compile(f" *[{kind}]+| +|[^ {kind}]")

    def split(self, text: str) -> Iterable[str]:
        """Pre-tokens of ``text`` with the space that the library puts before it; none of an empty text."""
        return _cuts(self._cut, " " + text.replace(self.SPACE, " ")) if text else ()

    def encode(self, parts: list[str]) -> list[list[int]]:
        found = self._model.encode([self.ANCHOR + part for part in parts], num_threads=1)
        return [ids[self._lead :] for ids in found]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: its piece with U+2581 as a space, or the byte that it stands for."""
        found = []
        for i in range(self._model.vocab_size()):
            piece = self._model.id_to_piece(i)
            if self._model.is_byte(i):
                found.append(bytes([int(piece[3:5], 16)]))
            else:
                found.append(piece.replace(self.SPACE, " ").encode())
        return found


def read_vocabulary(path: str) -> tuple[str, bytes]:
    """Kind and content of the vocabulary file at ``path``, which tasks turn into a vocabulary."""
    kinds = {".json": "bytes", ".model": "pieces"}
    kind = kinds.get(os.path.splitext(path)[1])
    if kind is None:
        raise ValueError(f"neither .json nor .model: {path}")
    with open(path, "rb") as file:
        return kind, file.read()


@lru_cache(maxsize=4)
def vocabulary(kind: str, raw: bytes) -> ByteLevel | Pieces:
    """The vocabulary of a file's content, built once in each Python worker."""
    return ByteLevel(raw) if kind == "bytes" else Pieces(raw)


def in_runs(texts: Iterator[str], characters: int) -> Iterator[list[str]]:
    """Runs of ``texts`` of about so many characters in all."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= characters:
            yield run
            run, size = [], 0
    if run:
        yield run
