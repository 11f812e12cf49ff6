"""Token counts of texts as a sentencepiece BPE model gives them, with a shortcut for whole tokens.

Two facts about a vocabulary are proved on the driver, once and from the vocabulary alone:

* *Cuts.* A merge only ever makes a string of the vocabulary. Where no vocabulary string holds two given
  characters side by side, no merge crosses that place, and the text may be cut there without a change of
  its tokens. Characters fall into classes (the components of "stand side by side in some vocabulary
  string"); a text is cut where the class changes, and before the space marks that follow other characters.
* *Whole tokens.* Each vocabulary string that is one such piece is encoded on its own; where that gives one
  token, the piece counts 1 wherever it stands.

Tasks cut texts into pieces, count those that are whole tokens by a look-up, and let the library merge only
the rest, each distinct piece once as long as it is remembered. No text is cut short and no row is moved.

Results for odd input: a null text counts as empty (0 bytes, 0 tokens); strings such as ``</s>`` or ``<0x0A>``
inside a text are ordinary characters; very long texts and pieces are whole; rows with a null or repeated
doc_id each get their own count; an empty table gives no rows; other columns stay, and the result goes into
one struct column that takes the name of any column it is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Documents with more tokens than this are over the limit.
LIMIT = 4096
#: Pieces that a task remembers at a time, and characters that it cuts at a time: bounds of memory only.
REMEMBERED, STEP = 1 << 19, 1 << 20
#: How the library writes a space.
MARK = "▁"
#: Put before a piece so that the library's space at the start of a text does not touch it.
GUARD = "\n"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def _check_plain(model: bytes) -> None:
    """The proof holds for BPE models that pass texts on as they are, but for marks in place of spaces."""
    from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec

    proto = ModelProto.FromString(model)
    spec, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
    plain = spec.add_dummy_prefix and spec.escape_whitespaces and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or spec.normalization_rule_tsv)
    own = {ModelProto.SentencePiece.USER_DEFINED, ModelProto.SentencePiece.UNUSED} & kinds
    if proto.trainer_spec.model_type != TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix or not plain or own:
        raise ValueError("whole-token counting needs a BPE model without normalization, user-defined or unused pieces")


def vocabulary(model: bytes) -> list[str]:
    """The strings that merges can make: neither control pieces nor single bytes."""
    sp = _processor(model)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]


def piece_pattern(strings: list[str]) -> str:
    """A regular expression whose matches tile any text so that no vocabulary string spans two of them."""
    group: dict[str, str] = {}

    def top(c: str) -> str:
        while group.setdefault(c, c) != c:
            group[c] = c = group[group[c]]
        return c

    for s in strings:
        if MARK in s.lstrip(MARK):
            raise ValueError(f"a space inside the vocabulary string {s!r}: texts can't be cut before spaces")
        for a, b in zip(s.lstrip(MARK), s.lstrip(MARK)[1:]):
            group[top(a)] = top(b)
    classes: dict[str, list[str]] = {}
    for c in group:
        classes.setdefault(top(c), []).append(c)
    runs = sorted(("".join(sorted(x)) for x in classes.values() if len(x) > 1 or x[0] * 2 in strings), key=len, reverse=True)
    alternatives = [f"[{re.escape(x)}]+" for x in runs] + [f"[^{MARK}]", "$"]
    return f"{MARK}*(?:{'|'.join(alternatives)})"


def whole_tokens(model: bytes) -> list[str]:
    """The vocabulary strings that are one piece and that the library, given them alone, turns into one token."""
    sp, strings = _processor(model), vocabulary(model)
    if any(GUARD in s for s in strings):
        raise ValueError("the guard character is part of the vocabulary")
    pieces, ahead = re.compile(piece_pattern(strings)), len(sp.encode(GUARD))
    alone = [s for s in strings if pieces.match(s).end() == len(s)]
    return [s for s, ids in zip(alone, sp.encode([GUARD + s for s in alone], num_threads=1)) if len(ids) == ahead + 1]


class PieceCounts:
    """Tokens of pieces: 1 for whole tokens, else what the library's merges leave."""

    def __init__(self, model: bytes, whole: list[str], pattern: str):
        self.sp, self.whole, self.pieces = _processor(model), whole, re.compile(pattern)
        self.ahead = len(self.sp.encode(GUARD))
        self.known = dict.fromkeys(whole, 1)

    def _learn(self, rows: list[list[str]]) -> None:
        """Merge the pieces of ``rows`` that are not known yet, each distinct one once."""
        new = list(set().union(*rows).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict.fromkeys(self.whole, 1)
            new = list(set().union(*rows).difference(self.known))
        merged = self.sp.encode([GUARD + x for x in new], num_threads=1)
        self.known.update(zip(new, (len(ids) - self.ahead for ids in merged)))

    def _long(self, text: str) -> int:
        """A text of more than STEP characters, some thousand pieces at a time."""
        found, n = self.pieces.finditer(text), 0
        while part := [m[0] for m in islice(found, STEP >> 4)]:
            self._learn([part])
            n += sum(map(self.known.__getitem__, part))
        return n

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out: list[int] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STEP):
                size += len(texts[end])
                end += 1
            marked = [MARK + x.replace(" ", MARK) if x else "" for x in texts[at:end]]
            if size > STEP:
                out.append(self._long(marked[0]))
            else:
                rows = [self.pieces.findall(x) for x in marked]
                self._learn(rows)
                out += [sum(map(self.known.__getitem__, row)) for row in rows]
            at = end
        return out


def counter(model: str | None = None):
    """A function of a text column that gives the number of its tokens. ``model`` is a file's path on the
    driver; its bytes (bounded by the vocabulary) travel with the tasks."""
    data = Path(model or default_model()).read_bytes()
    _check_plain(data)
    whole, pattern = whole_tokens(data), piece_pattern(vocabulary(data))

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = PieceCounts(data, whole, pattern)
        for texts in batches:
            raw = texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())
            yield pa.array(tokens.counts([x.as_py().decode("utf-8", "replace") for x in raw]), pa.int64())

    return count


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, text: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``out``: n_bytes (UTF-8), n_tokens and over_limit of each whole text."""
    whole: Column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = docs.withColumn(out, F.struct(F.octet_length(whole).cast("long").alias("n_bytes"), counter(model)(whole).alias("n_tokens")))
    return counted.withColumn(out, F.col(out).withField("over_limit", F.col(out)["n_tokens"] > limit))
