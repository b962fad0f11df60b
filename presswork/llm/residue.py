"""Problem 5: articles that hold template residue, filler, error messages or demands for scripts.

Lines are masked (numbers, addresses, dates) so that one message is one text on every site, masked texts are grouped by
exact hash over all sources, each group is classified once, and articles are marked by the groups their lines fall into.
What a group must show depends on how widely it recurs: a text that names nobody and stands between different lines on
several sources speaks to the reader, so a phrase anywhere in it decides. A text seen more narrowly may be an article's own
words about such a message: it must have the form of one, a placeholder, filler, or a message from its first word on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import read_table, written

# Rules on masked lines; numbers are "0" and addresses "@" there.
PLACEHOLDERS = [
    r"\{\{.*?\}\}", r"\{%.*?%\}", r"<%.*?%>", r"<!--.*?-->", r"<\?(?:php|=).*?\?>",
    r"[$#]\{[\w.\-]+\}", r"\$\$[A-Z][A-Z0-9_]*\$\$", r"%[A-Z][A-Z0-9_]{2,}%", r"%\([a-z_]+\)[sd]", r"@@[A-Z][A-Z0-9_]*@@",
    r"\[\[[A-Z0-9_ :.|]+\]\]", r"(?<![\w])__[A-Z][A-Z0-9_]*__(?![\w])", r"\{[0-9]+\}", r"\{[a-zA-Z]+(?:[_.][a-zA-Z0-9]+)*\}",
    r"(?i)\[object [a-z]\w*\]", r"\[/?[a-z_\-]+(?: [a-z_\-]+=[\"'][^\]\"']*[\"'])+ ?/?\]",
    r"(?i)\[(?:insert|insertar|ins[ée]rer|inserir|einf[üu]gen|add|enter|your|placeholder)\b[^\]]{0,80}\]",
    r"\bTK\b.*\bTK\b", r"\bTODO:", r"\bFIXME\b",
]
PROMPTS = [
    r"(?i)^\W*(?:your|votre|su|tu|seu|sua|ihr|ihre)\s+(?:headline|title|text|titre|texte|titular|t[ií]tulo|texto|titel|[üu]berschrift)\s+(?:goes\s+)?(?:here|ici|aqu[ií]|hier)\W*$",
    r"(?i)^\W*(?:type|write|enter|digite|escriba|escreva|saisissez|[ée]crivez|geben sie)\b(?=.*\b(?:here|ici|aqu[ií]|hier)\b).*\b(?:paragraph|paragraphe|p[aá]rrafo|par[aá]grafo|absatz|text|texte|texto)\b",
    r"(?i)^\W*(?:caption|l[ée]gende|legenda|leyenda|pie de foto|photo credit|bildunterschrift)\s+(?:to be added|to come|[àa] compl[ée]ter|[àa] venir|a completar|por completar|pendiente|pendente|folgt)\b",
]
FILLER = [r"(?i)\blorem\b.*\bipsum\b|\bipsum\b.*\blorem\b|\bdolor sit amet\b"]
ERRORS = [
    r"(?i)^\W*(?:http\s+)?(?:error|erreur|erro|fehler)\s+0\b",
    r"(?i)^\W*0\s*[-:]?\s*(?:service|not found|forbidden|bad gateway|gateway|internal server|too many|page not|unauthorized)",
    r"(?i)^\W*(?:the )?(?:service|servicio|servi[çc]o|server|dienst)\s+(?:is\s+|est\s+)?(?:temporarily|momentan[ée]ment|currently|no|indispon\S*|unavailable|nicht)\b",
    r"(?i)^\W*(?:access denied|acceso denegado|acc[èe]s refus[ée]|acesso negado|zugriff verweigert)\b",
    r"(?i)^\W*(?:oops|oups|opa|ops|ups|vaya|hoppla)\b.*\b(?:wrong|erreur|errado|mal|fehler|schief|error|erro)\b",
    r"(?i)^\W*(?:just a moment|one moment|loading|please wait|un momento|cargando|chargement|carregando|veuillez patienter|aguarde|bitte warten)\W*$",
    r"(?i)^\W*(?:checking|verifying|comprobando|verificando|v[ée]rification)\b.*\b(?:robot|human|browser|navegador|navigateur|humano|humain)\b",
    r"(?i)^\W*(?:page|p[áa]gina|la page demand[ée]e|seite)\s+(?:not found|introuvable|no encontrada|n[ãa]o encontrada|nicht gefunden)\b",
]
SCRIPTS = [
    r"(?i)^\W*(?:please\s+|veuillez\s+|por favor,?\s+|bitte\s+)?(?:enable|turn on|activate|allow|activer|activez|active|habilite|habilita|ative|aktivieren sie)\b.{0,40}?\b(?:java ?script|scripts?)\b",
    r"(?i)^\W*(?:to (?:view|see|use|read|continue)\b.*|you need (?:a|an|to)\b.*|(?:this|our) (?:site|page|content|website) (?:requires?|needs?)\b.*|your (?:web )?browser\b.*|su navegador\b.*|tu navegador\b.*|votre navigateur\b.*|o seu navegador\b.*|seu navegador\b.*|ihr browser\b.*)\b(?:java ?script|scripts?|scripting|skripte?)\b",
]
KINDS = {"placeholder": PLACEHOLDERS + PROMPTS, "filler": FILLER, "error": ERRORS, "script": SCRIPTS}
# Rules on widely recurring messages, wherever in the message the phrase stands.
WIDE = {
    "error": [
        r"\b(?:error|erreur|erro|fehler)\b\W*0\b", r"\b0\b\W*(?:error|erreur|erro|fehler)\b",
        r"\b(?:temporarily|currently) unavailable\b|\bindisponible\b|\bno (?:est[áa] )?disponible\b|\bindispon[íi]vel\b|\bnicht verf[üu]gbar\b",
        r"\bwent wrong\b|\berreur est survenue\b|\bsali[óo] mal\b|\bdeu errado\b|\bschiefgelaufen\b",
        r"\bnot a robot\b|\bpas un robot\b|\bno es un robot\b|\bn[ãa]o [ée] um rob[ôo]\b|\bkein roboter\b",
        r"\b(?:access|acceso|acc[èe]s|acesso|zugriff)\b.{0,20}\b(?:denied|denegado|refus[ée]|negado|verweigert|blocked|bloqueado|bloqu[ée])\b",
        r"\b(?:page|p[áa]gina|seite)\b.{0,40}\b(?:not (?:be )?found|introuvable|no (?:se )?encontr\w+|n[ãa]o (?:foi )?encontrad\w+|nicht gefunden)\b",
    ],
    "script": [
        r"\bjava ?script\b",
        r"\b(?:enable|allow|activate|turn on|activ\w+|autoris\w+|permit\w+|habilit\w+|ativ\w+|aktivier\w+|erlaub\w+)\b.*\b(?:scripts?|scripting|skripte?)\b",
    ],
}
#: Sources, and different neighbourhoods of lines, from which on a message recurs widely; words it may have at most.
WIDE_SOURCES, WIDE_PLACES, WIDE_WORDS = 3, 3, 40
#: A capitalised word inside a line, other than those of browsers: messages to everybody name nobody.
_NAMES = r"(?<=[\p{Ll},;] )(?!Java|Script|HTML|HTTP|Web|Internet|Ray\b)\p{Lu}\p{Ll}"
# fixed values: the public filler text, without its words that the five languages have too
FILLER_WORDS = (
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident culpa officia deserunt mollit laborum gravida nullam eget vestibulum pellentesque mauris "
    "curabitur faucibus tincidunt ultrices vitae posuere"
).split()
#: Different filler words that make a line filler; one does in a line of LEAST_WORDS words without any word that sentences of the five
#: languages are built with.
FILLER_LEAST, LEAST_WORDS = 3, 8
# fixed values: words without which hardly a sentence of eight words is made in English, French, Spanish, Portuguese or German
FUNCTION_WORDS = (
    "the of and to in a is for on that with as by at from was are this be it le la les des du de et un une en dans pour que qui sur au aux ce est "
    "par el los las del y se por con una al su o os as do da dos das e em um uma no na para com não mais der die das und von zu den mit ist im ein eine auf für dem nicht"
).split()

_TRIGGER = (
    r"(?i)[{}\[\]<]|[$]{2}|%\w+%|%\(|@@|__|^\W*\d|\b(?:tk|todo|fixme|here|ici|aqu[ií]|hier|caption|l[ée]gende|legenda|leyenda|pie|photo|bildunterschrift|error|erreur|erro|fehler|service|servicio|servi[çc]o|server|dienst"
    r"|access|acceso|acc[èe]s|acesso|zugriff|oops|oups|opa|ops|ups|vaya|hoppla|moment|momento|loading|wait|cargando|chargement|carregando|patienter|aguarde|warten|checking|verifying|comprobando|verificando|v[ée]rification"
    r"|page|p[áa]gina|seite|unavailable|indisponible|disponible|indispon[íi]vel|verf[üu]gbar|wrong|survenue|sali[óo]|errado|schiefgelaufen|rob[oô]t?|roboter|java ?script|scripts?|scripting|skripte?)\b|\b(?:" + "|".join(FILLER_WORDS) + r")\b"
)


def masked(line: Column) -> Column:
    """The line with numbers, addresses and dates replaced, white space collapsed; digits in braces stay placeholders."""
    t = F.regexp_replace(line, r"(?i)\b(?:https?://|www\.)\S+|\b\S+@\S+\.\w+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:example|com|org|net|info|int)\b(?:/\S*)?", "@")
    t = F.regexp_replace(t, r"\b\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?Z?)?\b", "0")
    t = F.regexp_replace(t, r"\b(?:[0-9a-f]*\d[0-9a-f]*)(?:[.,:/]\d+)*\b", "0")
    return F.trim(F.regexp_replace(t, r"[\s\p{Z}]+", " "))


def _any(rules: list[str]) -> str:
    return "|".join(f"(?:{r})" if not r.startswith("(?i)") else f"(?i:{r[4:]})" for r in rules)


def kind_of(text: Column, wide: Column) -> Column:
    """The kind of residue a masked line is, NULL for none; `wide` tells whether it recurs widely."""
    out = None
    for kind, rules in KINDS.items():
        test = text.rlike(_any(rules))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    for kind, rules in WIDE.items():
        out = out.when(wide & text.rlike(f"(?i){_any(rules)}"), kind)
    words = F.split(F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))), " ")
    latin = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in FILLER_WORDS])))
    bare = (F.size(words) >= LEAST_WORDS) & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in FUNCTION_WORDS]))
    return out.when((latin >= FILLER_LEAST) | ((latin >= 1) & bare), "filler")


def suspicious_lines(articles: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    """(article_id, source, line_no, message, place): masked lines that hold any sign the rules could look at; no other
    line can be residue, so the rest is not shuffled. `place` is the hash of the lines before and after."""
    lines = articles.select(F.col(id_col).alias("article_id"), F.col(source).alias("source"), F.split(text, "\n", -1).alias("all"))
    lines = lines.select("article_id", "source", "all", F.posexplode("all").alias("pos", "line")).where(F.col("line").rlike(_TRIGGER))
    place = F.xxhash64(F.get("all", F.col("pos") - 1), F.get("all", F.col("pos") + 1))
    return written(lines.select("article_id", "source", (F.col("pos") + 1).alias("line_no"), masked(F.col("line")).alias("message"), place.alias("place")), "suspicious")


def message_groups(lines: DataFrame) -> DataFrame:
    """(h, message, kind, lines, sources, wide): residue messages of the whole corpus, one row per exact masked text.

    Counts are algebraic over (message, source), so a message on a third of all pages is no task's burden; of its places
    a few suffice to tell copies of one article from a message that turns up everywhere.
    """
    keyed = lines.withColumn("h", F.xxhash64("message"))
    per_source = keyed.groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"), F.min("place").alias("p0"), F.max("place").alias("p1"))
    groups = per_source.groupBy("h").agg(
        F.min("message").alias("message"), F.sum("n").alias("lines"), F.count("source").alias("sources"),
        F.approx_count_distinct("p0").alias("places0"), F.approx_count_distinct("p1").alias("places1"),
    )
    spread = (F.col("sources") >= WIDE_SOURCES) & (F.greatest("places0", "places1") >= WIDE_PLACES)
    general = ~F.col("message").rlike(_NAMES) & (F.size(F.split("message", " ")) <= WIDE_WORDS)
    groups = groups.withColumn("wide", spread & general)
    return groups.withColumn("kind", kind_of(F.col("message"), F.col("wide"))).where("kind IS NOT NULL").drop("places0", "places1")


def residue_lines(articles: DataFrame, id_col: str = "article_id", source: str = "domain", text: str = "full_text") -> DataFrame:
    """(article_id, line_no, kind): every line that is residue. NULL and empty texts have none."""
    lines = suspicious_lines(articles, id_col, source, text)
    groups = message_groups(lines).select("h", "kind")
    return lines.withColumn("h", F.xxhash64("message")).join(groups, "h").select("article_id", "line_no", "kind")


def residue_articles(articles: DataFrame, id_col: str = "article_id", source: str = "domain", text: str = "full_text") -> DataFrame:
    """(article_id): articles with at least one line of residue."""
    return residue_lines(articles, id_col, source, text).select("article_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_articles(read_table(spark, sf_dir, "fulltext").select("article_id", "domain", "full_text"))


def p5_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue messages of the corpus with their spread over sources."""
    articles = read_table(spark, sf_dir, "fulltext").select("article_id", "domain", "full_text")
    groups = message_groups(suspicious_lines(articles, "article_id", "domain", "full_text"))
    return groups.select("message", "kind", "lines", "sources", "wide")


QUERIES = {"p5_found": p5_found, "p5_messages": p5_messages}
ORACLE: dict[str, str] = {}
