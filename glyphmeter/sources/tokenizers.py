"""Tokenizers from files: a spec string that tasks can build from, and the size of the vocabulary.

A path is a file of the `tokenizers` library, or a directory with tokenizer.json, or with vocab.json and
merges.txt (byte-level BPE with white space split off first).
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

SPECIALS = ("<s>", "</s>", "<unk>", "<pad>")
#: How ByteLevel splits a text.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which not every version of Unicode need say the same, and runs that take more than linear time.
_APART = re.compile("[^\x00-\u024f\u2010-\u2027]|\\s{1000}")


@dataclass(frozen=True)
class TokenizerSpec:
    name: str
    spec: str
    vocab_size: int

    def vocabulary(self) -> dict[str, int]:
        """The ids of all tokens, those that were added too."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec).get_vocab()


def load(name: str, path: str) -> TokenizerSpec:
    from tokenizers import Tokenizer

    if os.path.isfile(path):
        tok = Tokenizer.from_file(path)
    elif os.path.isfile(f"{path}/tokenizer.json"):
        tok = Tokenizer.from_file(f"{path}/tokenizer.json")
    elif os.path.isfile(f"{path}/vocab.json") and os.path.isfile(f"{path}/merges.txt"):
        tok = _byte_level(path)
    else:
        raise ValueError(f"no tokenizer at {path}")
    return TokenizerSpec(name, tok.to_str(), tok.get_vocab_size())


def _byte_level(path: str):
    from tokenizers import AddedToken, Tokenizer, decoders, models, pre_tokenizers, processors

    with open(f"{path}/vocab.json", encoding="utf-8") as f:
        vocab = json.load(f)
    with open(f"{path}/merges.txt", encoding="utf-8") as f:
        pairs = [tuple(line.rstrip("\n").split(" ")) for line in f if line.strip() and not line.startswith("#")]
    tok = Tokenizer(models.BPE(vocab=vocab, merges=[p for p in pairs if len(p) == 2]))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    tok.add_special_tokens([AddedToken(s, special=True) for s in SPECIALS if s in vocab])
    if {"<s>", "</s>"} <= set(vocab):
        ends = [(x, tok.token_to_id(x)) for x in ("<s>", "</s>")]
        tok.post_processor = processors.TemplateProcessing(single="<s> $A </s>", pair="<s> $A </s> $B </s>", special_tokens=ends)
    return tok


def byte_ranks(spec: str) -> tuple[dict[bytes, int], list[str]] | None:
    """The bytes and id of each token of a plain byte-level BPE, and the added tokens; None for any other tokenizer.

    tiktoken merges any two neighbours whose bytes are a token; `tokenizers` only the pair that the token was made from.
    Both give the same ids if every token comes from one pair, ids rise with the merges, and each token encodes to itself.
    """
    from tokenizers import Tokenizer

    d = json.loads(spec)
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    odd = [*(d.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(odd):
        return None
    vocab, printed = model["vocab"], [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    rising = made == sorted(set(made)) and -1 not in made
    if not rising or len(vocab) != 256 + len(made) or any(c not in vocab for c in byte) or any(c not in byte for x in vocab for c in x):
        return None
    own = Tokenizer.from_str(spec).model
    if any(len(own.tokenize(x)) != 1 for x in vocab):
        return None
    return {bytes(byte[c] for c in x): i for x, i in vocab.items()}, [x["content"] for x in d.get("added_tokens") or []]


def alike(text: str, added: list[str]) -> bool:
    """Whether a byte-level text is surely encoded alike, and in linear time, by tiktoken."""
    return _APART.search(text) is None and not any(x in text for x in added) and len(max(text.split(), key=len, default="")) < 1000


def load_all(config: dict) -> list[TokenizerSpec]:
    """From {name: path} or {name: {"path": path}}."""
    return [load(n, c if isinstance(c, str) else c["path"]) for n, c in config.items()]
