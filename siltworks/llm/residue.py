"""Template residue, filler, error pages and script notices (problem 10)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.keymap import key_map, may_hold
from siltworks.llm.shingles import mix
from siltworks.plans.runtime import materialize

# How templates mark a slot. NAME is a variable's name.
NAME = r"[A-Za-z][A-Za-z0-9_.\- ]{0,30}?"
MARKS = [
    r"\{\{\{?\s*" + NAME + r"\s*\}?\}\}",
    r"\$\{\s*" + NAME + r"\s*\}",
    r"#\{\s*" + NAME + r"\s*\}",
    r"<%=?\s*" + NAME + r"\s*%>",
    r"\[\[\s*" + NAME + r"\s*\]\]",
    r"«\s*" + NAME + r"\s*»",
    r"@@\s*" + NAME + r"\s*@@",
    r"\bXX_" + NAME + r"_XX\b",
    r"(?<![\w])__[A-Za-z][A-Za-z0-9_]*?__(?![\w(])",
    r"(?<![\w%$])%[A-Za-z][A-Za-z_]{2,30}%(?!\w)",
    r"(?<![\w$])\$[A-Za-z][A-Za-z_]{2,30}\$(?!\w)",
    r"\[(?:insert|your|enter|add|put|fill in|hier|insérer|insertar)\b[^\]\n]{0,40}\]",
    r"\((?:fill in|insert|enter your|to be filled)\b[^)\n]{0,40}\)",
    r"<!--[^>\n]{0,40}\bgoes here[^>\n]{0,20}-->",
    r"\b(?:todo|fixme)\b\s*:\s*(?:add|fill|write|insert|describe|provide|enter)\b(?:\s+[\w ]{0,30})?",
    r"\b\w*\s*:?\s*\bt\.?b\.?[dac]\b(?:\s+by\s+\w+)?",
    r"<[A-Za-z][A-Za-z_]{1,30}>(?!.*</)",
    r"(?<![\w{$#])\{[A-Za-z][A-Za-z_]{2,30}\}(?!\w)",
    r"(?<=[:\s])_{4,}(?=[\s.,]|$)",
    r"(?<!#)##[A-Za-z][A-Za-z0-9_]{1,30}##(?!#)",
    r"%%[A-Za-z][A-Za-z0-9_]{1,30}%%",
    r"\*\|[A-Za-z][A-Za-z0-9_:]{0,30}\|\*",
    r"<<[A-Za-z][A-Za-z0-9_]{1,30}>>",
    r"\[(?-i:[A-Z][A-Z0-9]+(?:[ _][A-Z][A-Z0-9]*)+)\]",
]
#: Forms of MARKS that are a slot wherever they stand open; the others are also syntax of shells, wikis, markup or languages.
SURE = {0, 3, 6, 7, 11, 12, 13, 14, 15, 19, 20, 21}
#: Names that the angle form of a mark does not have, being markup.
TAGS = "p br hr div span a b i u s em strong code pre ul ol li table tr td th tbody thead h img html body head script style sup sub small blockquote center font form input button label section article nav main footer header".split()
# Filler in place of content.
FILLER = [
    r"^(?:the )?(?:content|text|copy|details|description|body copy|more)(?: is| are)? (?:coming soon|pending|to follow|to come|goes here|to be added)",
    r"\b(?:section|text|content|chapter|body) (?:is )?(?:still )?to be written",
    r"^this (?:page|section|document) is intentionally left (?:blank|empty|without text)",
    r"^coming soon\b(?:\W+\w+){0,3}\W*$",
    r"^text[eo]? (?:a venir|en preparation|pendiente|de relleno)|^contenu a venir|^contenido en preparacion|^proximamente\b|^contenido pendiente",
    r"^hier (?:steht|folgt|kommt) (?:spater|noch|bald)|^(?:text|inhalt) folgt\b|^inhalt (?:in vorbereitung|folgt)|^platzhalter|^blindtext",
    r"^lorem ipsum\b|\bdolor sit amet\b|\bconsectetur adipisc",
    r"^(?:sample|dummy|placeholder|filler|example) (?:text|content|paragraph|heading|copy|list|sentence)\b",
    r"^description of the (?:issue|problem|bug|change)\.?$|^steps, expected, actual",
    r"^(?:heading|bullet|item|paragraph|title|subheading|section|column) (?:one|two|three|four|1|2|3)\b(?:\s+(?:heading|bullet|item|paragraph|section)? ?(?:one|two|three|four|\d))*$",
    r"^(?:asdf|qwerty|foo bar baz|bla bla|xxx+|test test|abc abc)\b",
    r"^(?:type|write|enter|put) (?:your|the) (?:text|content|description|title) here|^your (?:text|content|title) here",
]
# Messages of a site or service.
ERRORS = [
    r"^(?:http |error |erreur |fehler )?(?:4(?:0[0-9]|10|29)|5(?:0[0-9]|2[0-9]))\b(?: ?[-:–] ?|\s|$)(?!\d)(?=$|.*(?:page|seite|pagina|not|error|found|forbidden|gateway|denied|unavailable|here|server|tempor|too many|timeout|gone))",
    r"^(?:http|error|erreur|fehler)[ :]+(?:4|5)\d\d\b[\s.:–-]*$",
    r"^(?:http|error|erreur|fehler) [45]\d\d\b",
    r"^(?:page|file|seite|datei) (?:not found|nicht gefunden)|^(?:page|fichier) (?:introuvable|non trouvee)|^pagina no encontrada",
    r"\b(?:page|seite|pagina)\b.{0,40}\b(?:wandered off|asked for|demandee|solicitada|no longer exists|not here|existiert nicht|angeforderte)",
    r"^(?:access|permission) (?:denied|refused)|^acces (?:refuse|interdit)|^acceso denegado|^zugriff (?:verweigert|abgelehnt)|^forbidden\b",
    r"^(?:the )?service (?:is )?(?:temporarily )?unavailable|^service indisponible|^servicio no disponible|^dienst nicht verfugbar",
    r"^(?:internal|interner|interno|erreur) (?:server ?)?(?:error|fehler|interne)|^error interno|^gateway (?:trouble|time-?out)|^bad gateway|^too many requests|^demasiadas solicitudes|^trop de requetes|^zu viele anfragen",
    r"^(?:oops|whoops|sorry|hoppla|ups)[!,.](?!.*\b(?:i|i'm|i've|my|me)\b)",
    r"^something (?:broke|went wrong)|^etwas ist schiefgelaufen|^algo salio mal|^une erreur (?:est survenue|s'est produite)|^ein fehler ist aufgetreten|^ha ocurrido un error|^an (?:unexpected )?error (?:has )?occurred",
    r"^unhandled exception in\b|^uncaught (?:error|exception)\b|^traceback \(most recent|^stack trace\b|^at \w+ line \d+$",
    r"^fatal: (?:could not|cannot|failed)|^(?:database|db) (?:connection )?(?:error|failed)|^could not connect to\b.{0,50}\(timeout\)",
    r"^the upstream server\b|^(?:the )?request (?:\w+ )?could not be satisfied|^the (?:server|gateway) (?:did not respond|gave no)",
    r"^please (?:come back|try again) (?:in|later)|^try again later|^veuillez reessayer|^(?:bitte )?(?:spater erneut|versuchen sie es)|^vuelva a intentarlo|^intentelo (?:de nuevo|mas tarde)|^wait \d+ seconds and retry|^bitte spater",
    r"^your (?:address|ip|account)\b.{0,20} has been (?:blocked|banned|suspended)|^(?:your|the) session (?:has )?(?:ended|expired|timed out)|^(?:ihre|die) sitzung|^votre session|^su sesion",
    r"^(?:please )?(?:sign|log) in (?:again )?to (?:read|view|continue|see)|^you (?:must|need to) (?:be logged|log|sign) in",
    r"\bwas removed or the address is (?:mistyped|wrong)|^(?:invalid|broken|expired) link|^enlace (?:invalido|no valido)|^lien invalide|^ungultiger link",
    r"^(?:maintenance|wartung|mantenimiento)\b.{0,40}(?:in progress|scheduled|mode|en cours|en curso)|^(?:the )?(?:site|service|tracker) is (?:down|offline|under maintenance)|^down for maintenance|^wartungsarbeiten|^en mantenimiento|^site en maintenance",
]
# Notices that scripts are required.
SCRIPTS = [
    r"\b(?:enable|turn on|activate|allow)\b.{0,25}\b(?:javascript|scripts?|scripting|js|cookies)\b",
    r"\b(?:javascript|scripts?|scripting|js)\b.{0,25}\b(?:is|are|was|must be) (?:required|disabled|needed|enabled|off|turned off|switched off|blocked)",
    r"\b(?:needs?|requires?) (?:javascript|scripts?|scripting|js)\b|\b(?:javascript|js) (?:required|needed)\b",
    r"\bscripting switched off\b|^noscript\b|\bbrowser is not supported\b",
    r"\bjavascript\b.{0,20}\b(?:einschalten|aktivieren|activer|activar|habilit)|\b(?:activer|activez|activar|active|habilite)\b.{0,20}\b(?:javascript|scripts?)\b|\bscripts?\b.{0,15}\b(?:aktivieren|einschalten)\b",
    r"\b(?:without|ohne|sans|sin) (?:javascript|scripts?|skripte|scripting)\b.{0,40}\b(?:empty|blank|leer|vide|vacia|vacio|nothing|not work)",
    r"^checking your browser\b|^verifying (?:you are|that you are) human",
]
#: Words by which a site tells its reader of a failure, a refusal or a wait, or what to do then; evidence only for a text that is whole in several documents.
CUES = [
    r"\b(?:errors?|fail(?:s|ed|ure)?|unavailable|unreachable|offline|maintenance|denied|forbidden|unauthori[sz]ed|blocked|banned|expired|timed out|time-?out|not found|not available|no longer (?:available|exists?)|does(?: not|n't) exist|went wrong|could(?: not|n't)|can(?:not|'t| not)|unable to|redirect(?:ed|ing)?|captcha|robots?|are human|cookies?|javascript|under construction|overloaded|outage|too busy)\b",
    r"\b(?:try(?:ing)? (?:\w+ )?again|retry|refresh|reload|come back|check back|please wait|loading|(?:log|sign) ?in|webmaster|administrators?|support team|our (?:engineers|servers?|team)|apologi[sz]e|inconvenience|sorry|oops)\b",
    r"\b(?:fehler|fehlgeschlagen|nicht (?:gefunden|verfugbar|erreichbar|moglich)|wartung|gesperrt|abgelaufen|verweigert|neu laden|erneut|anmelden|bitte warten|spater)\b",
    r"\b(?:erreurs?|echec|echoue|indisponible|introuvable|interdit|expiree?|refuse|reessaye[rz]|recharge[rz]|veuillez|desoles?|connectez-vous)\b",
    r"\b(?:errores|fallo|fallado|no (?:disponible|encontrad[oa])|denegado|caducad[oa]|intente(?:lo)?|recargue|disculpe|inicie sesion|mantenimiento)\b",
    r"\b(?:errore|non (?:trovat[oa]|disponibile)|riprova(?:re)?|ricarica(?:re)?|scadut[oa]|negato|manutenzione|erro|nao (?:encontrad[oa]|disponivel)|tente novamente|recarregue|indisponivel|manutencao)\b",
    r"\b(?:fout|niet (?:gevonden|beschikbaar)|mislukt|opnieuw|geweigerd|onderhoud|blad|nie znaleziono|niedostepn[aey]|sprobuj ponownie|fel|hittades inte|forsok igen|inte tillganglig|ikke (?:funnet|fundet|tilgjengelig)|prov igen)\b",
    r"ошибк|не наиден|недоступ|попробуите|обновите|доступ запрещен|错误|失败|无法|未找到|请稍后|重试|刷新|エラー|見つかりません|アクセスてきません|再読み込み",
]
#: What a site speaks of and how it fails, evidence only for a text that says nothing else.
SITE = r"\b(?:pages?|(?:web ?)?site|server|service|database|connection|request|resource|session|account|browser|network|traffic|logged (?:out|off|in)|human|robots?|captcha|seite|verbindung|sitzung|dienst|datenbank|anfrage|inhalt|connexion|serveur|requete|base de donnees|pagina|sitio|servidor|conexion|sesion|servicio|solicitud)\b"
FAIL = r"\b(?:(?:is|are|was|were|does|do|did|can|could|has|have)(?: not|n't)|cannot|not (?:working|loaded|reachable)|error establishing|fail(?:s|ed|ure)?|unreachable|unavailable|exceeded|limit (?:is |was |has been )?(?:reached|exceeded)|out of resources|logged (?:out|off)|expired|timed out|refused|blocked|verify|verification|confirm|prove|check(?:ing)? (?:that|if|whether)|konnte nicht|kann nicht|konnten nicht|nicht (?:geladen|erreichbar|moglich)|fehlgeschlagen|abgelaufen|abgemeldet|impossible|n'a pas pu|ne peut pas|n'est pas|echoue|expiree|deconnecte|no se (?:pudo|puede)|no (?:esta|fue)|fallo|caducad[oa]|agotado)\b"
#: Words of which the names of templates' slots consist.
SLOT_WORDS = set("first last full middle given family name surname user customer client recipient contact person company organisation organization product item title subject date month year deadline email mail phone address street city country zip website price amount order invoice reference id employee team department account".split())
#: Defaults that stand where a value was not given.
DEFAULTS = set("n/a undefined nan".split())
# Frequent function words of the collection's languages; prose has some in every dozen words.
FUNCTION_WORDS = set(
    "the a an of to in and or is are was were be for on that with as at by from it this not no has have had but if when which so its their than "
    "der die das den dem des ein eine einen einem und oder ist sind war nicht auf in von zu mit als wenn bei aus nach nur so wir es für fur am im dass noch kein keinen schon "
    "le la les un une des du de et ou est sont que qui dans en par pour sur avec ne pas au aux ce cette nous il elle si lorsque rien "
    "el los las una y o es son que en por para con no se al del lo su si cuando sin este esta hay mas".split()
)
_MARK = re.compile("|".join(f"(?P<m{i}>{p})" for i, p in enumerate(MARKS)), re.I)
#: What every mark has somewhere.
_HINT = re.compile(r"[{<\[%$@«]|\((?:fill|insert|enter|to be)|__|##|\*\||XX_|todo|fixme|t\.?b\.?[dac]\b", re.I)
def _branches(patterns: list[str]) -> list[str]:
    """The alternatives of patterns at their top level."""
    out = []
    for p in patterns:
        depth, first = 0, 0
        for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|[()|]", p):
            depth += {"(": 1, ")": -1}.get(m.group(), 0)
            if m.group() == "|" and not depth:
                out.append(p[first : m.start()])
                first = m.end()
        out.append(p[first:])
    return out


_AT_START = re.compile("|".join(f"(?:{p[1:]})" for p in _branches(FILLER + ERRORS + SCRIPTS) if p[0] == "^"))
_ANYWHERE = re.compile("|".join(f"(?:{p})" for p in _branches(FILLER + ERRORS + SCRIPTS) if p[0] != "^"))
_NAMELIKE = re.compile(r"\w*_\w*|\b[a-z]+[A-Z]\w*|\b[nN]/[aA]\b|\b(?:[uU]ndefined|NaN|nan)\b")
_CUE, _SITE, _FAIL = re.compile("|".join(CUES)), re.compile(SITE), re.compile(FAIL)
_TOKEN = re.compile(r"[^\W_](?:[\w'’/-]*\w)?|_{2,}")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ABOUT = re.compile(r"\w_\w|->|\w\(\)|`|\"|“|”|\bcwe\b|\d+\.\d+\.\d+|\b[0-9a-f]{10,}\b")
_VALUE = re.compile(r"\w+(?:(?:_|->|\.|-)\w+)+(?:\(\))?|\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d[\d.,:]*")
_LEAD = re.compile(r"^(?:\[\d\d:\d\d\]|step=\S+|loss=\S+|[#>*+\-–•\s]+|\d+[.)]\s|<h\d>)+\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")
_LINE = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")


_TAG = re.compile(r"</?[a-z][a-z0-9]{0,10}>")


def _plain(s: str) -> str:
    """Lower-cased, without accents, markup and runs of blanks."""
    s = s.casefold()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("’", "'")
    if "<" in s:
        s = _TAG.sub(" ", s)
    return " ".join(s.replace("*", "").split())


def repaired(text: str) -> str:
    """Entities resolved, text that was decoded in the wrong code page decoded again, fenced code removed."""
    text = html.unescape(html.unescape(text))
    if "Ã" in text or "Â" in text:
        text = re.sub(r"[\xc2-\xf4][\x80-\xbf]+", lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), text)
    return re.sub(r"```.*?(?:```|\Z)", "\n", text, flags=re.S)


def segments(text: str) -> list[str]:
    """Lines without list marks and log prefixes, and their sentences."""
    out = []
    for line in _LINE.split(repaired(text)):
        line = _LEAD.sub("", line.strip()).strip()
        if line:
            out.extend(s for s in _SENTENCE.split(line) if s)
    return out


def is_page_text(plain: str) -> bool:
    """Whether a segment (as _plain gives it, without code, version or quotation that it would report on) is filler, an error message or a script notice."""
    if not plain:
        return False
    return (len(plain) <= 400 and (_AT_START.match(plain) or _ANYWHERE.search(plain)) is not None) or repeated_stub(plain) or wordless(plain)


def failed_page(plain: list[str]) -> bool:
    """Whether a text of these segments does nothing but tell that a site, its server or the reader's session does not work: at most three segments and 300 characters, each with a word of a failure, a refusal or what to do then, no first person and no list."""
    if not 0 < len(plain) <= 3 or sum(map(len, plain)) > 300 or any(re.search(r"\b(?:i|i'm|i've|my|me)\b|: ", p) for p in plain):
        return False
    return any(_SITE.search(p) and _FAIL.search(p) for p in plain) and all(_CUE.search(p) or _SITE.search(p) for p in plain)


def wordless(plain: str) -> bool:
    """Whether a long segment is filler words only: a dozen or more plain words, no function word of any language among them, and some repeated."""
    w = plain.rstrip(".").split()
    return len(w) >= 12 and all(x.isalpha() for x in w) and not any(x in FUNCTION_WORDS for x in w) and len(set(w)) < len(w)


def repeated_stub(plain: str) -> bool:
    """Whether one to eight words are repeated three times or more; the last word may be cut off."""
    w = plain.replace(".", " ").replace(",", " ").split()
    for period in range(1, min(len(w) // 3, 8) + 1):
        if len(w) >= max(6, 3 * period) and all(w[i] == w[i - period] for i in range(period, len(w) - 1)) and w[-period - 1].startswith(w[-1]):
            return True
    return False


def marks(segment: str) -> list[tuple[int, str, bool]]:
    """(form, name, quoted) of every slot mark. A mark within backticks, quotes or an expression is quoted."""
    out = []
    if not _HINT.search(segment):
        return out
    for m in _MARK.finditer(segment):
        form, word = int(m.lastgroup[1:]), m.group()
        if form == 16 and (word[1:-1].lower() in TAGS or re.fullmatch("h\\d", word[1:-1].lower())):
            continue
        before, after = segment[: m.start()], segment[m.end() :]
        quoted = before.count("`") % 2 == 1 or before.count('"') % 2 == 1 or (before[-1:] in "'‘“„" and after[:1] in "'’”“" and before[-1:] != "")
        out.append((form, _plain(re.sub(r"[^\w ]", "", word)), quoted))
    return out


def variable(token: str) -> bool:
    """Whether a word is a blank, a default, or a variable's name that says what a slot is for (two words or more, all of SLOT_WORDS)."""
    if token.strip("_") == "" or token.lower() in DEFAULTS:
        return True
    parts = _PARTS.findall(token)
    return len(parts) > 1 and ("_" in token or token[:1].islower() and not token.islower()) and all(p.lower() in SLOT_WORDS for p in parts)


def frames(segments_: list[list[str]], cache: dict[str, int]) -> np.ndarray:
    """For each word of each segment the hash of the segment without it, the same whatever stands there."""
    hashes = []
    for w in chain.from_iterable(segments_):
        h = cache.get(w)
        if h is None:
            if len(cache) > 500_000:
                cache.clear()
            h = cache[w] = xxhash.xxh64_intdigest(w.casefold())
        hashes.append(h)
    n = np.asarray([len(x) for x in segments_], np.int64)
    start = np.cumsum(n) - n
    place = (np.arange(len(hashes)) - np.repeat(start, n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        part = mix(np.asarray(hashes, np.uint64) + place * np.uint64(0x9E3779B97F4A7C15))
        whole = np.repeat(np.add.reduceat(part, start), n)
        return mix(whole - part + place * np.uint64(0xD1B54A32D192ED03) + np.repeat(n, n).astype(np.uint64))


def _framed(segment: str) -> list[str]:
    """The words of a segment of 4 to 30 words, else none."""
    tokens = _TOKEN.findall(segment)
    return tokens if 4 <= len(tokens) <= 30 else []


def _values(shared):
    """(doc_id, text) -> (skeleton, value): the ordinary words in the places that the map of open frames may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, cache = shared.value, {}
        for batch in batches:
            texts = list(set(batch.column(1).to_pylist()))
            for first in range(0, len(texts), 500):
                some = [x for t in texts[first : first + 500] for p in segments(t or "") if (x := _framed(p))]
                if not some:
                    continue
                key = frames(some, cache)
                hit = may_hold(bits, key)
                words = list(chain.from_iterable(some)) if len(hit) else []
                found = [(i, words[i]) for i in hit.tolist() if words[i].isalpha() and not variable(words[i])]
                if found:
                    at, values = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(key[list(at)].view(np.int64)), pa.array([_hash(v.casefold()) for v in values], pa.int64())], names=["skeleton", "value"])

    return run


def skeleton(segment: str, plain: str | None = None) -> str:
    """The segment with slot marks and values replaced by one sign, so that instances of a template align whether filled or not. plain: the segment's plain form, if it has no mark."""
    text = _plain(_MARK.sub("\x00", segment)) if plain is None else plain
    return " ".join(_GAP.sub(" ", _VALUE.sub("\x00", text)).split())


_GAP = re.compile(r"[^\w\x00]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("skeleton", pa.int64()), ("kind", pa.int8()), ("filler", pa.int64()), ("segment", pa.int64()), ("alone", pa.bool_()), ("cue", pa.bool_())])
#: Kinds of segment: without mark, with an open mark, with a quoted mark, page text, and a segment's frame around a variable's name, a default or a blank.
FILLED, OPEN, QUOTED, PAGE, NAMED = 0, 1, 2, 3, 4
_hash = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = segments(text or "")
            plain = [_plain(p) for p in parts]
            about = [_ABOUT.search(p) is not None for p in plain]
            alone = len(parts) <= 6 and not any(about)
            failed = alone and failed_page(plain)
            for p, low, subject in zip(parts, plain, about):
                found = marks(p)
                if found:
                    form = skeleton(p)
                    opened = [x for x in found if not x[2]]
                    kind, name, _ = (opened or found)[0]
                    rows.append((doc, _hash(form), OPEN if opened else QUOTED, _hash(f"{kind} {name}"), _hash(low), len(form.replace("\x00", "").split()) <= 1 or any(x[0] in SURE for x in opened), False))
                else:
                    page = failed or (not subject and is_page_text(low))
                    if any(variable(w) for w in _NAMELIKE.findall(p)):
                        tokens = _framed(p)
                        named = [i for i, w in enumerate(tokens) if variable(w)]
                        if len(named) == 1:
                            rows.append((doc, int(frames([tokens], cache).view(np.int64)[named[0]]), NAMED, _hash(tokens[named[0]]), 0, False, False))
                    form = skeleton(p, low)
                    rows.append((doc, _hash(form), PAGE if page else FILLED, 0, 0, alone, alone and "\x00" not in form and len(low) <= 400 and _CUE.search(low) is not None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, slots, page_texts, page_templates) of every document with residue: open slots, segments that are filler, error messages or script notices, and segments of whole-page templates.

    Records of one template also align word by word: a segment of 4 to 30 words without any one of them is a frame, and where a frame's place holds three different ordinary words or more in other texts, and three times as many as there are names in it, a variable's name, a default or a blank there is a slot left open. A text of at most three segments that does nothing but tell of a site or session that fails is page text.

    Segments (lines, then sentences) of one template align by their skeleton: marks of slots and values are the same sign in it. An open mark is residue if its form is a slot's only (SURE), if instances of its template hold values or other marks in its place, if it stands alone, or if its template's segments with marks are all one text, in however many documents; a mark of another form that stays the same where the rest of its template varies belongs to what the template says. Quoted marks, as in a report on them, are none. Segments that make up at least three documents of few segments and no subject, and mostly occur in such, are templates of error pages even without a known message if they have no values and a word of a failure, a refusal, a wait or what to do then (CUES); without such a word they may be any short text that is repeated.

    Null and empty texts have no residue; a repeated id is one document, a null id is ignored; fenced code is not looked at. Only skeleton hashes are shuffled."""
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = texts.mapInArrow(_segment_rows, "doc_id long, skeleton long, kind byte, filler long, segment long, alone boolean, cue boolean")
    rows = materialize(rows)
    named = rows.where(F.col("kind") == NAMED)
    bits = key_map(named, "skeleton")
    shared = df.sparkSession.sparkContext.broadcast(bits)
    around = texts if bits.any() else texts.where("false")  # no name, default or blank: no frame to fill
    values = around.mapInArrow(_values(shared), "skeleton long, value long").groupBy("skeleton").agg(F.count_distinct("value").alias("values"))
    unfilled = named.groupBy("skeleton").agg(F.count_distinct("filler").alias("names")).join(values, "skeleton").where((F.col("values") >= 3) & (F.col("values") >= 3 * F.col("names"))).select("skeleton")
    induced = named.join(unfilled, "skeleton", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("named"))
    marked = rows.where(F.col("kind") == OPEN)
    templates = rows.join(marked.select("skeleton").distinct(), "skeleton", "left_semi").groupBy("skeleton").agg(
        F.sum((F.col("kind") == FILLED).cast("int")).alias("filled"),
        (F.min(F.when(F.col("kind") == OPEN, F.col("filler"))) != F.max(F.when(F.col("kind") == OPEN, F.col("filler")))).alias("varied"),
        (F.min(F.when(F.col("kind") == OPEN, F.col("segment"))) == F.max(F.when(F.col("kind") == OPEN, F.col("segment")))).alias("one"),
    ).where((F.col("filled") > 0) | F.col("varied") | F.col("one")).select("skeleton", F.lit(True).alias("slot"))
    slots = marked.join(templates, "skeleton", "left").where(F.col("alone") | F.col("slot")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("slots"))
    pages = rows.where(F.col("kind") == PAGE).groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_texts"))
    each = rows.where(F.col("kind").isin(FILLED, PAGE)).groupBy("skeleton", "doc_id").agg(F.max("alone").alias("alone"), F.max("cue").alias("cue"), F.max("kind").alias("kind"))
    whole = each.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("alone").cast("int")).alias("whole"), F.max("kind").alias("kind"), F.max("cue").alias("cue")).where((F.col("whole") >= 3) & (F.col("whole") * 2 >= F.col("n")) & ((F.col("kind") == PAGE) | F.col("cue")))
    repeated = rows.where(F.col("alone") & F.col("kind").isin(FILLED, PAGE)).join(whole.select("skeleton"), "skeleton", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_templates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = slots.join(induced, "doc_id", "full").join(pages, "doc_id", "full").join(repeated, "doc_id", "full")
    return found.select(F.col("doc_id").alias(key), (F.coalesce("slots", F.lit(0)) + F.coalesce("named", F.lit(0))).alias("slots"), zero("page_texts"), zero("page_templates"))
