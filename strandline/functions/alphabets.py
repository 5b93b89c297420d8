"""Alphabets and letter codes.

An alphabet of n letters has codes 0 to n - 1, n for any letter, n + 1 for a gap and n + 2 for a gap
before the first or behind the last letter of an aligned sequence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    name: str
    letters: str
    any_letter: str
    #: Letters that are read as another one.
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(self.letters)

    @property
    def any(self) -> int:
        return self.size

    @property
    def gap(self) -> int:
        return self.size + 1

    @property
    def end_gap(self) -> int:
        return self.size + 2

    def codes(self) -> dict[str, int]:
        out = {c: k for k, c in enumerate(self.letters)} | {self.any_letter: self.any, "-": self.gap, ".": self.gap}
        return out | {a: out[b] for a, b in self.aliases.items()}

    def valid_pattern(self) -> str:
        """A character class of what may be read, in either case where letters are cased."""
        own = self.letters + "".join(self.aliases) + ("" if self.name == "dna" else self.any_letter)
        both = own + own.lower() if self.name in ("aa", "dna") else own
        return "[" + "".join("\\" + c if not c.isalnum() else c for c in dict.fromkeys(both)) + "\\-.]"

    def table(self, spark: SparkSession) -> DataFrame:
        """(code, chr, valid) as a small relation."""
        rows = [(k, c) for c, k in sorted(self.codes().items(), key=lambda x: (x[1], x[0]))]
        return spark.createDataFrame(rows, "code int, chr string")


# Letter order and aliases of the residue, nucleotide and state alphabets.
AA = Alphabet("aa", "ARNDCQEGHILKMFPSTWYV", "X", {"B": "D", "Z": "E", "U": "C", "J": "X", "O": "X"})
DNA = Alphabet("dna", "ACGT", "N")
STATES62 = Alphabet("states62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "*")
#: 90 printable states; the end gap has a code of its own here.
STATES90 = Alphabet("states90", "".join(chr(c) for c in range(33, 127) if chr(c) not in "*-.>"), "*")
#: 219 states are numbers only: they are written as bytes and read by code.
N_STATES219 = 219


def encoded(chars: Column, abc: Alphabet) -> Column:
    """Code of a one-character column (any case); null where the character is not of the alphabet."""
    pairs = [x for c, k in abc.codes().items() for x in (F.lit(c), F.lit(k))]
    key = F.upper(chars) if abc.name in ("aa", "dna") else chars
    return F.element_at(F.create_map(*pairs), key)


def decoded(code: Column, abc: Alphabet, lower: Column | None = None) -> Column:
    """The character of a code; end gaps are written as gaps."""
    chars = F.array(*[F.lit(c) for c in abc.letters + abc.any_letter + "--"])
    c = F.element_at(chars, code.cast("int") + 1)
    return c if lower is None else F.when(lower, F.translate(F.lower(c), "-", ".")).otherwise(c)


def cleaned(seq: Column) -> Column:
    """A sequence without gaps and white space."""
    return F.regexp_replace(seq, r"[\s.\-]", "")


def checked(seq: Column, abc: Alphabet) -> Column:
    """seq, or an error that names the first character that the alphabet lacks."""
    rest = F.regexp_replace(seq, f"{abc.valid_pattern()}|\\s", "")
    return F.when(F.length(rest) > 0, F.raise_error(F.concat(F.lit("not in the alphabet: "), F.substring(rest, 1, 1))).cast("string")).otherwise(seq)


def is_gap(c: Column) -> Column:
    return c.isin("-", ".")


def is_match_char(c: Column) -> Column:
    return c.rlike("^[A-Z-]$")


def is_insert_char(c: Column) -> Column:
    return c.rlike("^[a-z.]$")


def to_match(c: Column) -> Column:
    return F.translate(F.upper(c), ".", "-")


def to_insert(c: Column) -> Column:
    return F.translate(F.lower(c), "-", ".")


def cells(seqs: DataFrame, seq: str, abc: Alphabet, keys: list[str]) -> DataFrame:
    """keys, pos, a: one row for each letter of a sequence."""
    return seqs.select(*keys, F.posexplode(F.split(cleaned(F.col(seq)), "")).alias("pos", "c")).filter("c != ''").select(*keys, "pos", encoded(F.col("c"), abc).alias("a"))


def letter_counts(text: Column, abc: Alphabet) -> Column:
    """Array of (code, n) of a text, without exploding it: letters, then any letter; aliases count as what they are read as."""
    by: dict[int, list[str]] = {}
    for c, k in abc.codes().items():
        if k <= abc.any:
            by.setdefault(k, []).append(c)
    cased = abc.name in ("aa", "dna")
    both = lambda chars: list(dict.fromkeys(x for c in chars for x in ((c, c.lower()) if cased else (c,))))

    def n(chars):
        """Bytes that go when a letter, which is one byte, is taken out: scans of bytes, without patterns."""
        gone = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in both(chars)]
        total = gone[0]
        for x in gone[1:]:
            total = total + x
        return total

    return F.array(*[F.struct(F.lit(k).alias("a"), n(c).cast("long").alias("n")) for k, c in sorted(by.items())])
