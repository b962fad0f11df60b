"""Problem 10: text that looks the same is brought to one form, script by script and token by token.

Step 1 composes each text and folds forms that differ in no visible way (full width, letters in another font, ligatures,
spaces, invisible characters). Step 2 repairs look-alike letters: a token's dominant script is the one most of its letters
can only belong to, letters of other scripts are replaced by that script's look-alikes, and the result is taken only if the
corpus vocabulary has it, either as a token of one script or as the repair of another spelling. Step 3 groups equal forms.

A text is read once, in Arrow batches, as composition and tokens need its characters; everything between texts is joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from unicodedata import decomposition, is_normalized, normalize

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.session import read_table, written

# fixed values: letters of other scripts drawn like a Latin letter, in the order of the Latin letters beside them
CYRILLIC = "АВЕЅІЈКМНОРСТХаеѕіјорсухԁԛԝһӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXaesijopcyxdqwhl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγνορυϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXayvopucj"
ARMENIAN = "ՍՏԼՕհոսօ"
ARMENIAN_LATIN = "USLOhnuo"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎥ"
CHEROKEE_LATIN = "ABCDEGHJKLMPRSTVWZi"
COPTIC = "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ"
COPTIC_LATIN = "ABEHIKMNOPCTYXopc"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_LATIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"
OTHER = "ԌɡɑⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯᴄᴏᴠᴡᴢꜱᴜ"
OTHER_LATIN = "GgaivxlcdmIVXLCDMcovwzsu"
# fixed values: ligatures and their letters
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
    "\u0132": "IJ", "\u0133": "ij", "\u01c7": "LJ", "\u01c8": "Lj", "\u01c9": "lj", "\u01ca": "NJ", "\u01cb": "Nj", "\u01cc": "nj",
}
# fixed values: code points without a shape, and spaces other than U+0020, as first and last of each range
INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
]
SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

LATIN_OF = dict(
    zip(
        CYRILLIC + GREEK + ARMENIAN + CHEROKEE + COPTIC + LISU + OTHER,
        CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN + CHEROKEE_LATIN + COPTIC_LATIN + LISU_LATIN + OTHER_LATIN,
    )
)
#: Letters that make a token worth a look: those of the scripts above, and look-alikes inside Latin and among numbers.
SUSPECT = r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}\p{Script=Cherokee}\p{Script=Coptic}\p{Script=Lisu}" + OTHER + "]"
#: A token is a run of letters and combining marks.
TOKEN = r"[\p{L}\p{M}\p{Nl}]+"
#: Distinct tokens a task gathers before it hands them on.
VOCABULARY_KEPT = 300_000


def folding() -> dict[int, str | None]:
    """Steps without a choice, by code point: invisible characters go, special spaces become U+0020, full-width forms,
    letters and digits of other fonts and ligatures become their plain characters."""
    table: dict[int, str | None] = {c: None for a, b in INVISIBLE for c in range(a, b + 1)}
    table |= {c: " " for a, b in SPACES for c in range(a, b + 1)}
    table |= {ord(k): v for k, v in LIGATURES.items()}
    for c in [*range(0x2100, 0x2150), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        kind, *plain = decomposition(chr(c)).split()[:2] or [""]
        if kind in ("<font>", "<wide>"):
            table[c] = "".join(chr(int(x, 16)) for x in plain)
    return table


def latin_look(token: str) -> str:
    """The token with every look-alike replaced by its Latin letter: the same for all tokens that look the same."""
    return normalize("NFC", token.translate(_TO_LATIN))


def dominant_repair(token: str) -> str:
    """The token in its dominant script: that of the letters no other script draws alike, Latin where none decides."""
    import regex

    only = {
        "latin": len(regex.findall(r"\p{Script=Latin}", token.translate(_TWINS))),
        "cyrillic": len(regex.findall(r"\p{Script=Cyrillic}", token.translate(_TWINS))),
        "greek": len(regex.findall(r"\p{Script=Greek}", token.translate(_TWINS))),
    }
    look = latin_look(token)
    if only["cyrillic"] > only["latin"] and only["cyrillic"] >= only["greek"]:
        return normalize("NFC", look.translate(_TO_CYRILLIC))
    if only["greek"] > only["latin"] and only["greek"] > only["cyrillic"]:
        return normalize("NFC", look.translate(_TO_GREEK))
    return look


_TO_LATIN = str.maketrans(LATIN_OF)
_TO_CYRILLIC, _TO_GREEK = str.maketrans(CYRILLIC_LATIN, CYRILLIC), str.maketrans(GREEK_LATIN, GREEK)
#: Letters that two scripts draw alike, on either side, decide nothing.
_TWINS = {ord(c): None for c in [*LATIN_OF, *LATIN_OF.values()]}


def _mapped(df: DataFrame, schema: str, of: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """Rows of the first column's values, batch by batch: of() is called once per task and maps a batch's values to the
    values of the columns after the first, which is passed on."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = of()
        for b in batches:
            columns = [pa.array(c, t) for c, t in zip(each(b.column(b.num_columns - 1).to_pylist()), (arrow[k] for k in kinds[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=list(names))

    return df.mapInArrow(run, schema)


def plain_forms(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form, spelling, odd, letters): each text after the steps without a choice, the hash of its code points, its
    tokens with suspect letters, and whether it has a letter. Texts of ASCII characters need no step. Line breaks, tabs,
    case, digits of other scripts and accents stay; NULL stays NULL."""

    def of() -> Callable[[list], list[list]]:
        import regex

        table, suspect, token, letter = folding(), regex.compile(SUSPECT), regex.compile(TOKEN), regex.compile(r"\p{L}")

        def each(texts: list[str | None]) -> list[list]:
            forms, spellings, odds, letters = [], [], [], []
            for t in texts:
                form, odd = t, []
                if t is not None and not t.isascii():
                    form = t.translate(table)
                    if not is_normalized("NFC", form):
                        form = normalize("NFC", form)
                    if suspect.search(form):
                        odd = sorted({x for x in token.findall(form) if suspect.search(x)})
                forms.append(form)
                spellings.append(None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
                odds.append(odd)
                letters.append(bool(form and letter.search(form)))
            return [forms, spellings, odds, letters]

        return each

    kind = dict(documents.dtypes)[id_col]
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return _mapped(slim, f"doc_id {kind}, form string, spelling binary, odd array<string>, letters boolean", of)


def vocabulary(forms: DataFrame) -> DataFrame:
    """(look): the tokens of all forms, each once or a few times; a task keeps what it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, kept = regex.compile(TOKEN).findall, set()
        for b in batches:
            for t in b.column(0).to_pylist():
                kept.update(find(t) if t else ())
            if len(kept) > VOCABULARY_KEPT:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(kept), pa.string())], names=["look"])
                kept = set()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(kept), pa.string())], names=["look"])

    return forms.select("form").mapInArrow(run, "look string")


def vocabulary_repairs(forms: DataFrame) -> DataFrame:
    """(token, repaired): tokens with letters of several scripts, or of look-alikes only, whose repair the corpus has.

    The corpus has a repair if it occurs as a token itself or if two different tokens have it; so two texts that look
    the same always get the same form, and a foreign word that only resembles Latin is left alone.
    """
    tokens = forms.where(F.size("odd") > 0).select(F.explode("odd").alias("token")).distinct()
    odd = written(_mapped(tokens, "token string, look string, repaired string", lambda: _looks), "odd-tokens")
    looks = odd.select("look").distinct()
    # tokens of the corpus that are nobody's disguise: only those that some odd token looks like are kept
    plain = vocabulary(forms).join(looks, "look", "left_semi").distinct().select("look", F.lit(1).alias("n"))
    several = odd.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = plain.select("look").unionByName(several.select("look")).distinct()
    # where the corpus writes the look in Latin, that spelling wins; else the dominant script's, one per look
    rep = odd.groupBy("look").agg(F.min("repaired").alias("own")).join(plain, "look", "left").select("look", F.when(F.col("n").isNotNull(), F.col("look")).otherwise(F.col("own")).alias("repaired"))
    return odd.select("token", "look").join(known, "look", "left_semi").join(rep, "look").where("token <> repaired").select("token", "repaired")


def _looks(tokens: list[str]) -> list[list]:
    return [[latin_look(t) for t in tokens], [dominant_repair(t) for t in tokens]]


@F.pandas_udf(T.StringType())
def _substituted(forms: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
    import regex

    token = regex.compile(TOKEN)

    def one(form, old, new):
        if form is None or old is None:
            return None
        table = dict(zip(old, new))
        return token.sub(lambda m: table.get(m.group(), m.group()), form)

    return pd.Series([one(*x) for x in zip(forms, olds, news)], dtype=object)


def _repaired(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, form, spelling, letters) with all look-alikes repaired; only documents that hold a repaired token are joined."""
    forms = written(plain_forms(documents, id_col, text), "forms")
    repairs = written(vocabulary_repairs(forms), "repairs")
    tokens = forms.where(F.size("odd") > 0).select("doc_id", F.explode("odd").alias("token"))
    own = tokens.join(repairs, "token").groupBy("doc_id").agg(F.collect_list("token").alias("olds"), F.collect_list("repaired").alias("news"))
    odd = forms.where(F.size("odd") > 0).join(own, "doc_id", "left")
    form = F.coalesce(_substituted(F.when(F.col("olds").isNotNull(), F.col("form")), "olds", "news"), F.col("form"))
    even = forms.where(F.size("odd") == 0).select("doc_id", "form", "spelling", "letters")
    return even.unionByName(odd.select("doc_id", form.alias("form"), "spelling", "letters"))


def canonical_forms(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form): every text in the one form that equal-looking texts share; NULL stays NULL, empty stays empty."""
    return _repaired(documents, id_col, text).select("doc_id", "form")


def same_looking(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts with a letter that look the same and differ in their code points.

    Spellings are first folded to one row per (form, text); a form with one spelling, however often it is copied, ends
    there. Only differing spellings meet, and they are opened to their documents last, by joins on the spelling.
    """
    forms = _repaired(documents, id_col, text).where("letters")
    keyed = written(forms.select("doc_id", F.unhex(F.md5("form")).alias("look"), "spelling"), "spellings")
    spellings = keyed.select("look", "spelling").distinct()
    several = spellings.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    mixed = spellings.join(several, "look", "left_semi")
    pairs = mixed.alias("a").join(mixed.alias("b"), F.expr("a.look = b.look AND a.spelling < b.spelling")).selectExpr("a.spelling AS s", "b.spelling AS t")
    left = pairs.join(keyed.selectExpr("spelling AS s", "doc_id AS x"), "s")
    both = left.join(keyed.selectExpr("spelling AS t", "doc_id AS y"), "t")
    return both.selectExpr("least(x, y) AS doc_id_a", "greatest(x, y) AS doc_id_b")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_forms(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p10_found": p10_found, "p10_forms": p10_forms}
ORACLE: dict[str, str] = {}
