"""Token ids of whole texts by a public vocabulary file, each different piece of a batch once.

A text is cut before each blank that a non-blank follows. The vocabulary's split pattern always
starts a token there, so pieces can be encoded apart and their ids joined: the ids are those of the
whole text. Pieces recur, so Arrow tells the different ones of a batch apart; those not met before go to
the library joined, and the ids of all are gathered by place. Pieces met are kept in flat arrays, up to a bound.
Texts that hold an added token of the file (``<|endoftext|>``) are encoded whole: the library gives it its own id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: pieces that go to the library in one call; pieces that a worker keeps with their ids, and the bytes of these
CALL_PIECES = 1024
KEPT_PIECES, KEPT_BYTES = 800_000, 48 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file's place on this machine; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: a blank at the head, before white space or at the end: such texts are encoded as they are
_ODD_BLANK = re.compile(r"\A | (?=\s|\Z)")


class Encoder:
    """Encodes texts to ids as ``uint16`` (vocabularies above 65,536 ids: ``uint32``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD_BLANK.pattern, *added]))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
        #: bytes of each id: the byte-level alphabet writes one character for each byte
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.kept, self.kept_ids, self.kept_sizes = pa.array([], pa.large_string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text from the library."""
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 256):
            found = self.tokenizer.encode_batch_fast(texts[at:at + 256], add_special_tokens=False)
            out += [np.array(f.ids, self.dtype) for f in found]
        return out

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that each follow a blank, in one array, and the number of each piece's ids. Joined pieces are
        told apart by their bytes: a call for each would cost more than its ids."""
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), CALL_PIECES):
            part = pieces.slice(at, CALL_PIECES)
            ids = self._whole([" " + " ".join(part.to_pylist())])[0]
            ends = np.cumsum(pc.binary_length(part).to_numpy() + 1)
            flat.append(ids)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where different pieces are kept, after those not met before were encoded."""
        if len(self.kept) + len(pieces) > KEPT_PIECES or self.kept.nbytes + self.kept_ids.nbytes > KEPT_BYTES:
            self._forget()
        found = pc.index_in(pieces, value_set=self.kept)
        new = pieces.filter(found.is_null())
        places = found.fill_null(-1).to_numpy().astype(np.int64)
        places[places < 0] = len(self.kept) + np.arange(len(new))
        ids, sizes = self._joined(new)
        self.kept = pa.concat_arrays([self.kept, new])
        self.kept_ids, self.kept_sizes = np.concatenate([self.kept_ids, ids]), np.concatenate([self.kept_sizes, sizes])
        return places

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        odd = [i for i, t in enumerate(texts) if self.odd.search(t)]
        out = [np.zeros(0, self.dtype)] * len(texts)
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        left = set(odd)
        plain = [i for i, t in enumerate(texts) if t and i not in left]
        if not plain:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        starts = split.offsets.to_numpy()
        parts = split.flatten()
        heads = self._whole(parts.take(pa.array(starts[:-1])).to_pylist())  # a text's first piece has no blank
        later = np.ones(len(parts), bool)
        later[starts[:-1]] = False
        coded = parts.filter(pa.array(later)).dictionary_encode()
        places = self._places(coded.dictionary)
        codes = np.empty(len(parts), np.int64)
        codes[later] = places[coded.indices.to_numpy()]
        codes[~later] = np.arange(len(self.kept), len(self.kept) + len(heads))
        flat = np.concatenate([self.kept_ids, *heads])
        sizes = np.concatenate([self.kept_sizes, np.fromiter(map(len, heads), np.int64, len(heads))])
        counts = sizes[codes]
        ends = np.cumsum(counts)
        gathered = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + counts, counts) + np.arange(ends[-1])]
        for i, ids in zip(plain, np.split(gathered, ends[starts[1:-1] - 1])):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
