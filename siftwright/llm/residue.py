"""Problem 9: template residue, filler, error pages and script notices.

Whole texts are cut into units: messages (lines and the sentences in them) and
the fields that template syntaxes mark. Numbers, addresses, dates and quoted
identifiers are masked, and the exact hash of every unit of every document is
grouped across sources; only hashes are shuffled, never texts. The units that
recur in ``WIDELY`` sources or more are then classified by phrase and
placeholder rules, once for each distinct unit, and the documents that hold a
classified unit come out by a join on its hash.

What cannot recur by its nature is certain alone: fields of syntaxes that prose
has no use for, invented Latin, keyboard mash and words without end. It goes
through the same groups, under the constant of its form.

Rules speak of messages addressed to the reader of the page; sentences that
mention or quote one are told apart by their own words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.pytext import unescape_all
from siftwright.session import Scratch, read_table

#: Sources in which a unit must recur to be classified.
WIDELY = 3

# --- Fields: what a template engine should have filled. -----------------------------
# Syntax -> (certain alone, what every match holds as it stands in lower case, pattern).
_NAME = r"[^\W\d]\w*(?:[.\-]\w+)*"
_UPPER = r"[A-ZÀ-Þ][A-ZÀ-Þ0-9]*(?:[._][A-ZÀ-Þ0-9]+)*"
_FIELD = rf"\s*{_NAME}(?:[ ]{_NAME}){{0,3}}\s*"
_INSERT = ("inserire", "inserisci", "insert", "insérer", "insertar", "einfügen")
FIELDS = {
    "mustache": (True, "{{", rf"\{{\{{[#/^&>!]?{_FIELD}(?:\|[^{{}}\n]{{0,40}})?\}}\}}"),
    "block": (True, "{%", r"\{%-?\s*\w+[^%\n]{0,80}?-?%\}"),
    "dollar": (True, "${", rf"\$\{{{_FIELD}\}}"),
    "hash": (True, "#{", rf"#\{{{_FIELD}\}}"),
    "velocity": (True, "$!", rf"\$!\{{?{_NAME}\}}?"),
    "erb": (True, "<%", r"<%[=#-]?[^%\n]{1,80}?%>"),
    "at": (True, "@@", r"@@\w[\w. ]{0,40}@@"),
    "dunder": (True, "__", r"(?<![\w_])__[^\W_][\w.]{0,40}?__(?![\w_])"),
    "object": (True, "[object", r"\[object Object\]"),
    "percent": (True, "%", rf"%{_UPPER}(?:[ ]{_UPPER}){{0,3}}%"),
    "wiki": (True, "[[", rf"\[\[{_FIELD}\]\]"),
    "bracket": (False, "[", rf"\[{_UPPER}(?:[ ]{_UPPER}){{0,3}}\]"),
    "bracket_your": (False, "[", r"(?i:\[(?:your|il tuo|la tua|votre|ihre?|tu|nome|cognome|name|date|data)(?:[ ]\w+){0,3}\])"),
    "insert": (False, _INSERT, rf"(?i:[\[(](?:{'|'.join(_INSERT)})\b[^\])\n]{{0,60}}[\])])"),
    "angle": (False, "<", rf"<{_UPPER}(?:[ ]{_UPPER}){{0,3}}>"),
    "escaped_angle": (False, "&lt;", rf"&lt;{_FIELD}&gt;"),
    "printf": (False, "%", r"(?<![\w%])%(?:\d+\$)?[sd](?!\w)"),
    "position": (False, "{", r"(?<![\w{$#])\{\d{1,2}\}(?![\w}])"),
    "curly": (False, "{", rf"(?<![{{$#!%\w])\{{{_FIELD}\}}(?![}}])"),
    "undefined": (False, "undefined", r"(?<!\w)undefined(?!\w)"),
}
_FIELDS = [
    (name, certain, need, re.compile(p)) for name, (certain, needs, p) in FIELDS.items() for need in ((needs,) if isinstance(needs, str) else needs)
]
#: Roman numerals and other upper-case words in square brackets that editors write.
_EDITORIAL = re.compile(r"\[(?:[IVXLCDM]+|SIC|N\.?D\.?[RTA]\.?|OMISSIS|A|B|C|D)\]")
_OPEN, _CLOSE = "«\"'“‘`„", "»\"'”’`“"
#: A message with one of these speaks of a message instead of being one.
MENTION = re.compile(
    r"\b(?:si scrive|si usa|si dice|chiam(?:a|ano)|indica(?:no)?|significa|spiega|vuol dire|il quesito|la voce|"
    r"risponde con|come in|per esempio|insieme [a-z] =|means|is called|is written|signifie|s'écrit|bedeutet|se escribe)\b"
)
#: What stands right before a field that is named, not left unfilled.
_NAMING = re.compile(
    r"\b(?:si (?:scrive|usa|dice)|(?:one )?writes?|il campo|la variabile|la stringa|il marcatore|"
    r"the (?:field|variable|string|tag|marker)|chiamat[oa]|called|means|s'écrit|schreibt man|se escribe)\s*$"
)
#: Words of programming in the sentence around a field.
_CODING = re.compile(
    r"\b(?:printf?|format|strings?|string[ah]e?|variab(?:il[ei]|les?)|variablen?|mustache|jinja|php|python|java ?script|html|"
    r"sintassi|syntax|syntaxe|placeholders?|segnaposto|one writes|si inserisce|template engine|in c\b)\b"
)

# --- Messages, as fixed values: (kind, pattern over the masked form). Only units that recur widely are read. -------
_JS = r"(?:javascript|scripts?|gli script|les scripts|los scripts|skripte)"
_PAGE = r"(?:page|file|url|resource|document|site|content|link|pagina|sito|risorsa|documento|contenuto|indirizzo|seite|datei|inhalt|fichier|ressource|página|recurso|archivo)"
_STATUS = (
    r"(?:(?:page|file|url|document|resource|object)? ?not found|forbidden|gone|unauthori[sz]ed|bad request|bad gateway|gateway time-?out|"
    r"service (?:temporarily )?unavailable|internal server error|too many requests|method not allowed|request time-?out|payment required|moved permanently)"
)
_LEAD = r"^(?:(?:spiacenti|siamo spiacenti|ci dispiace|ops|oops|attenzione|errore|error|sorry|we.re sorry|nota|avviso|warning|désolé|lo sentimos|leider|entschuldigung)\s*[,:!.\-–]*\s*)?"
PHRASES = [
    # notices that scripts are required
    ("script", rf"\b(?:enable|activate|turn on|allow|switch on|requires?|needs?) (?:\w+ )?{_JS}\b"),
    ("script", rf"\b{_JS} (?:is|are|must be|has to be|needs to be|have been|support is)\b(?: \w+)? ?(?:required|disabled|not enabled|not supported|turned off|switched off|needed|enabled|blocked|activated|turned on|off)\b"),
    ("script", rf"\bbrowser (?:blocks|does not support|doesn.t support|has disabled|has) {_JS}\b"),
    ("script", rf"\b(?:does not|doesn.t|will not|won.t|cannot) (?:work|run|function|load) (?:\w+ )?without {_JS}\b"),
    ("script", rf"\b(?:abilit|attiv|consent|richied|necessit|riattiv)\w* (?:di |il |l'uso di |l'esecuzione di )?{_JS}\b"),
    ("script", rf"\b(?:funzion\w+|disponibil[ei]|visualizzabil[ei]) senza (?:gli )?{_JS}\b|\bsenza {_JS} (?:\w+ )*non (?:funziona|è)"),
    ("script", rf"\b{_JS} (?:è |sono |risulta )?(?:disattivat|disabilitat|bloccat|richiest|necessari|obbligatori)\w\b"),
    ("script", rf"\b(?:activ(?:e|a|ar|er|ez)|habilit(?:e|a|ar)|autoris(?:er|ez)|requiert|nécessite|requiere|necesita) (?:le |el )?{_JS}\b"),
    ("script", rf"\b{_JS} (?:est|está|ist) (?:\w+ )?(?:désactivé|desactivado|deaktiviert|requis|nécessaire|necesario|erforderlich|blockiert)\b"),
    ("script", rf"\b(?:aktivieren|schalten|erlauben) sie (?:bitte )?{_JS}\b|\b(?:benötigt|erfordert) {_JS}\b"),
    ("script", r"<noscript\b"),
    # error pages and program failures
    ("error", r"<title>\s*(?:error|errore)?\s*<n>\s+[^<]{2,60}</title>"),
    ("error", rf"^(?:http\s*(?:/[\d.<n>]+)?\s*)?(?:error|errore|fehler|erreur)?\s*(?:<n>)?\s*[-–:.|]?\s*{_STATUS}(?: (?:nginx|apache)\S*)?[\W_]*$"),
    ("error", r"^(?:errore|error|fehler|erreur)\s+<n>\s*[-–:]\s*\S.{2,60}$"),
    ("error", rf"{_LEAD}(?:seite|página|page|pagina|site|sito|file|url|link|contenuto|risorsa) (?:nicht gefunden|no encontrada|introuvable|not found|non trovat[oa]|inesistente)\s*(?:\(?<n>\)?)?[\W_]*$"),
    ("error", r"^(?:access denied|accesso negato|accès refusé|acceso denegado|zugriff verweigert|permission denied|autorizzazione negata)\s*(?:\(?<n>\)?)?[\W_]*$"),
    ("error", r"\b(?:une erreur (?:est survenue|s'est produite)|an? (?:\w+ )?error (?:has |was )?(?:occurred|encountered)|si è verificato un (?:\w+ )?errore|ha ocurrido un error|se ha producido un error|ein fehler ist aufgetreten)\b"),
    ("error", r"\b(?:could not|cannot|can.t|unable to|failed to|was unable to) (?:process|complete|handle|load|connect to|open|fulfil+|reach) (?:\w+ )?(?:request|page|database|server|file|content|site)\b"),
    ("error", rf"\b(?:this|the|your)(?: requested)? {_PAGE}(?: you \w+(?: \w+){{0,3}})? (?:could not|cannot|can.t|was not|is not|isn.t|does not|doesn.t|no longer)\b.{{0,20}}\b(?:loaded|displayed|found|available|exists?|accessible|reached)\b"),
    ("error", rf"\brequested {_PAGE} (?:was|is|has|could)\b"),
    ("error", r"\bimpossibile (?:connettersi|collegarsi|raggiungere|caricare|visualizzare|aprire|trovare|elaborare|completare)\b"),
    ("error", rf"\b{_PAGE} (?:che (?:cerchi|stai cercando|hai richiesto|hai cercato) |richiest[oa] |cercat[oa] )?(?:non (?:esiste|è (?:più |stat[oa] )?(?:trovat[oa]|disponibile|raggiungibile))|è stat[oa] (?:rimoss|spostat|eliminat|cancellat)[oa])"),
    ("error", r"^(?:il )?(?:sito|servizio|server)(?: \w+)? (?:è )?(?:in manutenzione|temporaneamente|momentaneamente|non disponibile)\b|\b(?:down for|under|undergoing) maintenance\b|\btorneremo (?:presto )?online\b|\bwartungsarbeiten\b|\ben maintenance\b"),
    ("error", r"\b(?:session (?:has |is )?(?:expired|timed out)|sessione (?:è )?scaduta|session (?:a )?expirée?|sesión ha (?:caducado|expirado)|sitzung ist abgelaufen)\b"),
    ("error", r"\b(?:qualcosa è andato storto|non hai i permessi|something went wrong|algo salió mal|etwas ist schief|quelque chose s'est mal passé)\b"),
    ("error", r"\b(?:please )?try again (?:later|in a few)|\briprova(?:re)? (?:più tardi|tra qualche)\b|\bcontact the (?:site )?administrator\b"),
    ("error", r"\btraceback \(most recent call last\)|^file (?:<q>|<addr>|\"[^\"\n]+\"), line <n>"),
    ("error", r"^(?:\w+\.)*[a-z_]*(?:error|exception)\b ?: ?\S"),
    ("error", r"^(?:php )?(?:fatal|parse|syntax|catchable fatal) error\s*:\s*\S|^segmentation fault\b|\bstack ?trace\b"),
    ("error", r"^(?:php )?(?:warning|notice|deprecated)\s*:\s.*\b(?:in|on line)\b.*(?:<addr>|line <n>)"),
    ("error", r"\bexception in thread \"|\bnull ?pointer ?exception\b|\bat \w+(?:\.\w+)+\(\w+\.java:<n>\)"),
    ("error", r"\berror establishing a database connection\b|\b(?:connection|request) (?:refused|reset|timed out)\b|\bthis site can.t be reached\b|\btoo many connections\b"),
    # filler in place of content
    ("filler", r"\blorem ipsum\b"),
    ("filler", r"\btest[oi] segnaposto\b|^(?:qui )?segnaposto[\W_]*$|\b(?:placeholder|dummy|sample|filler) text\b|\btexte? (?:de )?substitution\b|\bblindtext\b|\btexto de (?:relleno|ejemplo)\b|\btexte d'exemple\b|\bbeispieltext\b|\bplatzhalter\b"),
    ("filler", r"^qui (?:va|andrà|ci va|inserire)\b|^inser(?:ire|isci) (?:qui\b|(?:il |un )?(?:testo|titolo|contenuto)\b)"),
    ("filler", r"^(?:un )?testo d(?:i|'|a) ?(?:esempio|prova|sostituire|inserire|definire)[\W_]*$"),
    ("filler", r"^(?:your |add |insert |enter |put |type )+(?:own )?(?:text|title|content|description)(?: goes)?(?: here)?[\W_]*$|\b(?:text|title|content) goes here\b"),
    ("filler", r"^contenut[oi] (?:\w+ )?in (?:preparazione|arrivo|allestimento|costruzione|fase di)\b|^(?:pagina |sito |sezione )?in (?:costruzione|allestimento)[\W_]*$|^(?:this )?(?:page |site )?(?:is )?under construction[\W_]*$|^coming soon[\W_]*$|^prossimamente[\W_]*$"),
    ("filler", r"^(?:todo|fixme|tbd|tbc|xxx)\b\s*[:\-–]?\s*(?:\S.*)?$"),
    ("filler", r"^da (?:completare|compilare|definire|inserire|scrivere)(?: a cura d\w+ \w+)?[\W_]*$|^to be (?:completed|added|defined|written|announced|determined)[\W_]*$|^à compléter[\W_]*$|^por completar[\W_]*$"),
    ("filler", r"^\[?(?:bozza|draft|entwurf|brouillon|borrador)\]?(?:\s*[:\-–].*|[\W_]+(?:titolo|title|testo|text|titel)\b.*)?$"),
    ("filler", r"(?:\b(?:titolo|testo|title|text|titel|titre|texte|texto|título)\b[\W_]*){3,}"),
]
_RULES = [(kind, re.compile(p)) for kind, p in PHRASES]
#: Words from which a unit is too long to be a message to the reader.
LONGEST_MESSAGE = 60

# --- Filler that cannot recur word for word. ------------------------------------------
#: Keyboard mash and words typed to fill a line: four of them in a row.
_MASH = re.compile(r"(?:\b(?:testo|titolo|bla+h?|asdf\w*|qwert\w*|zxcv\w*|x{3,}|a{3,}|prova|test|foo|bar)\b[\W_]*){4,}")
_MASH_WORDS = ("testo", "titolo", "bla", "asdf", "qwert", "zxcv", "xxx", "aaa", "prova", "test", "foo", "bar")
#: Endings of Latin-looking filler words, and function words that real Latin has.
_ENDINGS = ("um", "us", "ae", "it", "at", "is", "or", "em")
_LATIN_FUNCTION = frozenset("et in ad est non cum ut sed per qui quae quod ex de ab si nec aut atque sunt esse".split())
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words and share of Latin-looking ones from which a message is filler.
LATIN_WORDS, LATIN_SHARE = 8, 0.8

_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")
_DATES = re.compile(r"\d(?<!\w\d)\d{0,3}[./\-]\d{1,2}[./\-]\d{1,4}\b")
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_MAIL = re.compile(r"\b[\w.+-]+@[\w-]+\.[\w.]+\b")
_PATH = re.compile(r"(?<![\w<])/(?:[\w.\-]+/)+[\w.\-]*")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_QUOTED = re.compile(r"(['\"])(?<!\w['\"])[\w.\-]+\1(?!\w)")
_SCRIPT = re.compile(r"\b(?:java script|js)\b")
_EDGE = " \t\r\f\v\u00a0\u200b\ufeff*•·-–—_|#=~"


def plain(text: str) -> str:
    """``text`` as the rules read it: escapes resolved, composed characters."""
    text = unescape_all(text) if "&" in text or "\\u" in text else text
    return text if text.isascii() else normalize("NFC", text)


def mask(text: str) -> str:
    """Lower case; addresses, dates, quoted identifiers and numbers masked."""
    if "://" in text or "www." in text:
        text = _LINK.sub("<addr>", text)
    if "@" in text:
        text = _MAIL.sub("<addr>", text)
    if "/" in text:
        text = _PATH.sub("<addr>", text)
    text = _NUMBER.sub("<n>", _DATES.sub("<date>", text)).lower()
    if "'" in text or '"' in text:
        text = _QUOTED.sub("<q>", text)
    return _SCRIPT.sub("javascript", text) if "js" in text or "java script" in text else text


def latin_filler(masked: str) -> bool:
    """A run of made-up words with Latin endings and no Latin function words."""
    spaced = masked.split()
    if len(spaced) < LATIN_WORDS or not _LATIN_FUNCTION.isdisjoint(spaced):
        return False
    words = _LETTERS.findall(masked)
    if sum([w.endswith(_ENDINGS) for w in words]) < LATIN_SHARE * max(len(words), LATIN_WORDS):
        return False
    made_up = sum(len(w) > 3 and w.endswith(_ENDINGS) and w.isascii() for w in words)
    return made_up >= LATIN_SHARE * len(words) and _LATIN_FUNCTION.isdisjoint(words)


def fields(text: str) -> Iterator[tuple[str, bool, str]]:
    """``(syntax, certain, field)`` of the fields left unfilled in ``text``, but for quoted and mentioned ones."""
    low = text.lower()
    for name, certain, need, pattern in _FIELDS:
        if need not in low:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if a and b < len(text) and text[a - 1] in _OPEN and text[b] in _CLOSE:
                continue
            if name == "bracket" and _EDITORIAL.fullmatch(m[0]):
                continue
            begin, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            around = sentence_at(text[begin : end if end >= 0 else len(text)], a - begin).lower()
            if _CODING.search(around) or _NAMING.search(text[max(begin, a - 40) : a].lower()):
                continue
            yield name, certain, _NUMBER.sub("<n>", " ".join(m[0].lower().split()))


def sentence_at(line: str, at: int) -> str:
    """The sentence of ``line`` that holds position ``at``."""
    begin = 0
    for m in _SENTENCE.finditer(line):
        if m.start() > at:
            return line[begin : m.start()]
        begin = m.end()
    return line[begin:]


def messages(text: str) -> set[str]:
    """Masked forms of the lines of ``text`` and of the sentences in them, stripped of bullets and rules."""
    found = set()
    for line in mask(text).split("\n"):
        line = " ".join(line.split()).strip(_EDGE)
        if line:
            found.add(line)
            if ". " in line or "! " in line or "? " in line or "… " in line:
                found.update(s.strip(_EDGE) for s in _SENTENCE.split(line))
    found.discard("")
    return found


def units(text: str) -> set[tuple[str, bool, str]]:
    """``(form, certain, unit)`` of one text: all its messages and fields.

    ``form`` is ``message``, ``latin``, ``mash`` or the syntax of a field.
    """
    found, written, text = set(fields(text)), text, plain(text)
    if text is not written:  # escaped syntax comes to light; what reads as an angle bracket now was looked at as written
        found.update(f for f in fields(text) if f[0] != "angle")
    low = text.lower()
    typed = sum(map(low.count, _MASH_WORDS)) > 3
    for m in messages(text):
        if latin_filler(m):
            found.add(("latin", True, "<latin>"))
        elif typed and sum(map(m.count, _MASH_WORDS)) > 3 and _MASH.search(m) and not MENTION.search(m):
            found.add(("mash", True, "<mash>"))
        found.add(("message", False, m))
    return found


def classify(form: str, unit: str) -> str | None:
    """Kind of a unit that recurs widely (or is certain), or None."""
    if form in FIELDS:
        return "placeholder"
    if form != "message":
        return "filler"
    if len(unit.split()) > LONGEST_MESSAGE:
        return None
    for kind, rule in _RULES:
        if rule.search(unit):
            return None if MENTION.search(unit) else kind
    return None


UNITS = "doc_id bigint, source string, form string, certain boolean, unit string"
_UNITS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("form", pa.string()), ("certain", pa.bool_()), ("unit", pa.string())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All units of ``doc_id, source, text``, each once per document."""
    for batch in batches:
        rows = [
            (doc, source, *u)
            for doc, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)))
            for u in units(text)
        ]
        columns = zip(*rows) if rows else [[]] * len(_UNITS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNITS)], schema=_UNITS)


KINDS = "h bigint, form string, certain boolean, kind string, unit string"
_KINDS = pa.schema([("h", pa.int64()), ("form", pa.string()), ("certain", pa.bool_()), ("kind", pa.string()), ("unit", pa.string())])


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, form, certain, unit`` with their kind; units of no kind go."""
    for batch in batches:
        kinds = [classify(f, u) for f, u in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
        out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kinds, pa.string()), batch.column(3)], schema=_KINDS)
        yield out.filter(pa.array([k is not None for k in kinds], pa.bool_()))


def find_residue(documents: DataFrame, spark: SparkSession, widely: int = WIDELY) -> tuple[DataFrame, DataFrame]:
    """``flagged (doc_id, kind)`` and ``groups (kind, form, unit, documents, sources)``.

    ``documents (doc_id, source, text)``. Null and blank texts are no case; a
    null source counts as one source of its own. ``groups`` holds the units that
    are certain or stand in ``widely`` sources, and have a kind.
    """
    scratch = Scratch(spark, "residue")
    texts = documents.where("doc_id is not null and length(text) > 0").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    found = texts.mapInArrow(scan, UNITS).select("doc_id", F.xxhash64("source").alias("s"), F.xxhash64("form", "unit").alias("h"), "certain", "form", "unit")
    found = scratch.cut(found)  # columns apart: what follows reads hashes, and texts of wide units only
    per_source = found.groupBy("h", "s", "certain").agg(F.countDistinct("doc_id").alias("n"))
    counted = per_source.groupBy("h", "certain").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("sources"))
    wide = scratch.cut(counted.where(F.col("certain") | (F.col("sources") >= widely)).select("h", "documents", "sources"))
    shown = found.select("h", "form", "certain", "unit").join(wide.select("h"), "h", "left_semi")
    shown = shown.groupBy("h", "form", "certain").agg(F.min("unit").alias("unit"))
    kinds = shown.select("h", "form", "certain", "unit").mapInArrow(judge, KINDS)
    groups = scratch.cut(kinds.join(wide, "h").select("h", "kind", "form", "unit", "documents", "sources"))
    flagged = found.select("doc_id", "h").join(groups.select("h", "kind"), "h").select("doc_id", "kind").distinct()
    return flagged, groups.drop("h")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(_documents(spark, sf_dir), spark)[0].select("doc_id").distinct()


def p9_message_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every residue unit in masked form with its documents and sources."""
    return find_residue(_documents(spark, sf_dir), spark)[1]


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stay after the exclusion."""
    documents = read_table(spark, sf_dir, "documents")
    return documents.join(p9_found(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "lang", "source")
