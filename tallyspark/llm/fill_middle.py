"""Fill-in-the-middle forms of texts, cut at the edges of units.

A unit grammar names disjoint classes of characters and which neighbours stay together. It is
translated to one zero-width regex: a boundary lies wherever the character behind and the one ahead
are neighbours that do not stay together. Spark's ``split`` at that regex loses nothing, so pieces
joined again are the text, and cutting needs no Python. The empty text, for which ``split`` gives one
empty piece, has no units.

Edge cases: a null text is the empty text; a null doc_id has the empty string as its decimal form;
rows that repeat each get a row; an empty table gives an empty result; other columns of the input
are ignored. A text is held with its pieces by one
task, some 60 bytes a unit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UnitGrammar:
    """Characters by class (Java regex, one character each, together all characters) and the pairs
    (class behind, class ahead) between which no unit ends."""

    classes: dict[str, str]
    together: frozenset[tuple[str, str]] = frozenset()

    def boundary(self) -> str:
        """The zero-width regex of all spots between two units, which may match nowhere."""
        ways = []
        for behind, pattern in self.classes.items():
            ahead = [p for name, p in self.classes.items() if (behind, name) not in self.together]
            if len(ahead) == len(self.classes):
                ways.append(f"(?<={pattern})(?=.)")
            elif ahead:
                ways.append(f"(?<={pattern})(?={'|'.join(ahead)})")
        return "(?s)" + ("|".join(ways) or "(?!)")


CODE_POINTS = UnitGrammar({"any": "."})
#: Lines with the line feed that ends them.
LINES = UnitGrammar({"feed": r"\n", "other": r"[^\n]"}, frozenset({("other", "other"), ("other", "feed")}))
#: Runs of white space and runs of anything else.
WORDS = UnitGrammar({"gap": r"[ \t-\r]", "word": r"[^ \t-\r]"}, frozenset({("gap", "gap"), ("word", "word")}))
#: Runs of letters with the space before them, runs of digits, and every other character alone.
TOKENS = UnitGrammar(
    {"letter": r"[\p{L}\p{M}]", "digit": r"\p{N}", "space": "[ ]", "other": r"[^\p{L}\p{M}\p{N} ]"},
    frozenset({("letter", "letter"), ("digit", "digit"), ("space", "letter")}),
)


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        own = (self.prefix, self.suffix, self.middle)
        if len(set(own)) < 3 or not all(own) or any(x[0] in y[1:] for x in own for y in own):
            raise ValueError("sentinels must differ, and none may begin with a later character of one")

    def within(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def units(text: Column, grammar: UnitGrammar = CODE_POINTS) -> Column:
    """The units of a text in order; none of the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def _draw(group: int) -> Column:
    """The ``group``-th unsigned 32-bit integer, from 0, of the column ``seed`` (hexadecimal)."""
    return F.conv(F.substring("seed", 8 * group + 1, 8), 16, 10).cast("long")


def _joined(start: Column, stop: Column) -> Column:
    return F.array_join(F.slice("pieces", start + 1, stop - start), "")


def fill_in_middle(docs: DataFrame, grammar: UnitGrammar = CODE_POINTS, sentinels: Sentinels = Sentinels(), plain_percent: int = 10, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """One row a text: doc_id, text, n (units), form (plain, psm, spm), prefix, middle (null where
    plain) and output.

    The first four 32-bit groups of sha256 of ``seed``:doc_id choose the two cuts among the n + 1
    edges of units, whether the text stays plain, and the form. A text that is empty or holds a
    sentinel stays plain, so an output can always be read back.
    """
    s = sentinels
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    rows = rows.withColumns({
        "pieces": units(F.col("text"), grammar),
        "seed": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
    })
    n = F.size("pieces").cast("long")
    rows = rows.withColumns({"n": n, "one": _draw(0) % (n + 1), "two": _draw(1) % (n + 1)})
    plain = (F.col("text") == "") | s.within(F.col("text")) | (_draw(2) % 100 >= 100 - plain_percent)
    rows = rows.withColumns({
        "form": F.when(plain, "plain").when(_draw(3) % 100 < spm_percent, "spm").otherwise("psm"),
        "from": F.least("one", "two").cast("int"),
        "to": F.greatest("one", "two").cast("int"),
    })
    cut = F.col("form") != "plain"
    rows = rows.withColumns({
        "prefix": F.when(cut, _joined(F.lit(0), F.col("from"))),
        "middle": F.when(cut, _joined(F.col("from"), F.col("to"))),
        "suffix": F.when(cut, _joined(F.col("to"), F.col("n").cast("int"))),
    })
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(s.prefix), "prefix", F.lit(s.suffix), "suffix", F.lit(s.middle), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(s.suffix), "suffix", F.lit(s.prefix), "prefix", F.lit(s.middle), "middle"))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", "text", "n", "form", "prefix", "middle", output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output was made of, from the output and its form alone.

    No sentinel lies in the parts, and none begins with a later character of one, so none arises
    across an edge and each is found at its only place.
    """

    def after(whole: Column, mark: str) -> Column:
        return F.substring_index(whole, mark, -1)

    def before(whole: Column, mark: str) -> Column:
        return F.substring_index(whole, mark, 1)

    s = sentinels
    head, middle = before(output, s.middle), after(output, s.middle)
    psm = F.concat(after(before(head, s.suffix), s.prefix), middle, after(head, s.suffix))
    spm = F.concat(after(head, s.prefix), middle, after(before(head, s.prefix), s.suffix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
