"""Byte-level BPE vocabularies: the cuts made before merging, and token bytes.

A text is cut by a pattern of contractions, letters, numbers, other characters and white space;
merges stay inside those pre-tokens.
"""

import json
import re
import unicodedata

import regex

#: The pattern of pre-tokens, as in ``public_tokenizers.PATTERN``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where no pre-token, and no piece of a space-marking model, crosses: before a space that
#: follows a visible character.
SAFE = re.compile(r"(?<=\S)(?= )")
#: Characters of a text that are worked on at a time.
WINDOW = 1 << 20


#: The same cuts by the standard library's faster patterns, for texts of ``PLAIN`` characters only.
PLAIN_PATTERN = r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]+|_+)+|\s+(?!\S)|\s+"
#: Kinds of characters: plain ones; those that the two libraries of patterns class differently; those
#: whose class depends on the Unicode version of a library.
PLAIN, ODD, UNASSIGNED = 0, 1, 2


class Kinds(dict):
    """Kind of each character met so far."""

    def __missing__(self, c):
        category = unicodedata.category(c)
        if category == "Cn":
            kind = UNASSIGNED
        else:
            kind = ODD if category in ("Nl", "No") or "\x1c" <= c <= "\x1f" else PLAIN
        self[c] = kind
        return kind

    def worst(self, text):
        return max(map(self.__getitem__, set(text)), default=PLAIN)


def byte_alphabet():
    """The character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def windows(text, size=WINDOW):
    """Parts of a text of about ``size`` characters, cut only where every tokenizer cuts."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class ByteLevelTokenizer:
    """A tokenizer file of this kind; any other kind is refused.

    ``plain``: strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path, plain=False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        before = rules["pre_tokenizer"] or {}
        if rules["normalizer"] or before.get("type") != "ByteLevel" or rules["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE without a normaliser is supported")
        if before["add_prefix_space"] or not before.get("use_regex", True) or rules["model"]["ignore_merges"]:
            raise ValueError("only the usual pre-token pattern without a prefix is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in rules["added_tokens"]):
            raise ValueError("only special tokens that stand for themselves are supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        special = [] if plain else sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kinds = Kinds()
        self.finders = {PLAIN: re.compile(PLAIN_PATTERN).findall, ODD: regex.compile(PATTERN).findall}
        self.alphabet = byte_alphabet()
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)

    def ids(self, text):
        """Ids of a text by the library as it is."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pretoken_length(self, pretoken):
        """Number of tokens of one pre-token."""
        return len(self.tokenizer.model.tokenize(pretoken.encode().decode("latin-1").translate(self.alphabet)))

    def token_bytes(self):
        """For each id the bytes it stands for."""
        back = {c: b for b, c in self.alphabet.items()}
        out = [b""] * (max(self.vocabulary.values()) + 1)
        for entry, i in self.vocabulary.items():
            out[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        return out

    def pretokens(self, text):
        """Lists of pre-tokens of a text between its special tokens, window by window.

        A part with a character outside the common Unicode versions comes as its text instead: it goes
        to the library as it is.
        """
        for window in windows(text):
            for part in self.special.split(window) if self.special else [window]:
                if part:
                    find = self.finders.get(self.kinds.worst(part))
                    yield find(part) if find else part

    def specials(self, text):
        return len(self.special.findall(text)) if self.special else 0
