"""Problem 4: template residue, filler text and error pages.

Three kinds of evidence are combined.

* Detectors: unfilled placeholders in the usual template notations, filler text,
  and lines that are an error message or a notice that scripts are required.
* Address, title and body: a title is mismatched if none of its terms stands in
  the page's body or address; a response of little information, if no line of
  its body has a term in common with the title, the address or another line.
* Host evidence: a mismatched title or response whose wording, with numbers, names
  and addresses masked, comes back under many addresses of several hosts is
  residue even if no detector knows it.  For titles the terms
  are weighed, too: over all pages that have a term in their title, the share on
  which the body has it as well tells words of content from words of residue.

All comparisons are made row by row in Arrow batches.  What is shuffled are the
hashes of mismatched responses and of titles, with map-side combining.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged
from .boilerplate import host_of, stored_texts
from .furniture import furniture_flags, title_like
from .lineforms import PROSE, line_form
from .tables import common_words, slices

# --- fixed values -----------------------------------------------------------
# Names that stand for fields of a template.
FIELD_NAMES = """
title subtitle headline subline teaser author name firstname lastname user username company city country address date time year day month
summary description desc text body content article page site url link image img price product item label category tag email phone lang
value variable placeholder insert keyword keywords number count id heading slug caption
""".split()
# Words of the usual filler text.
LOREM = frozenset("""
lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu
fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
""".split())
# Lines, as a whole, that are filler.
FILLER_LINES = [
    r"Dummy headline\..*", r"(?:Dummy|Example|Placeholder|Sample) (?:text|copy|paragraph|content)\b.*", r"(?:Your|Add your|Put your|Enter your|Type your) (?:text|content|copy|description)\b(?: goes)?(?: here)?\b.*", r"(?:Text|Content) goes here\b.*", r"Click (?:here )?to edit\b.*", r"Replace this (?:text|paragraph|copy)\b.*", r"Lorem ipsum\b.{0,40}", r"(?:This is )?sample (?:page|text)\b\.?.*", r"Insert .{2,40} here\b.*",
    r"(?-i:TODO):? .*", r"Content coming soon\b.*", r"Coming soon\.?", r"(?:This (?:page|site|section) is )?(?:still )?under construction\b.{0,60}", r"(?:Your|Insert|Add) (?:title|headline|heading|name|logo|image|caption) here\b.{0,40}", r"(?:Sample|Dummy|Example|Test) (?:headline|title|heading|article|caption)\b.{0,40}", r"Text to follow\.?", r"Placeholder(?: text)?\b.{0,60}",
    r"(?:Blindtext|Beispieltext|Mustertext|Fülltext)\b.*", r"Hier steht (?:später|bald) .*", r"Inhalt folgt\.?.{0,40}", r"Platzhalter.{0,60}",
    r"Votre texte ici\b.*", r"Ici votre texte\b.*", r"(?:Exemple de texte|Faux texte)\b.*", r"Contenu à venir\b.*", r"Texte de remplacement.{0,40}", r"Insérez .{2,40} ici\b.*",
    r"Escriba aquí su texto\b.*", r"Contenido próximamente\b.*", r"Texto de (?:relleno|ejemplo|muestra).{0,40}", r"Su texto aquí\b.*",
    r"(?:Inserire|Inserisci|Scriva|Scrivi) qui .{2,60}", r"Contenuto in arrivo\b.*", r"Testo (?:segnaposto|di esempio|di prova|fittizio).{0,40}", r"(?:Il )?(?:suo|tuo) testo qui\b.*",
    r"(?:Escreva|Insira|Coloque) aqui .{2,60}", r"Conteúdo em breve\b.*", r"Texto de (?:exemplo|preenchimento)\b.{0,40}", r"(?:O )?seu texto aqui\b.*",
    r"(?:Hier komt|Plaats hier|Typ hier) .{2,60}", r"Inhoud volgt\b.*", r"(?:Voorbeeldtekst|Opvultekst)\b.{0,40}", r"Uw tekst hier\b.*",
    r"(?:Введите|Вставьте) (?:здесь )?.{0,20}текст.{0,40}", r"Здесь будет .{2,60}", r"Скоро здесь .{2,60}",
]
# Lines, as a whole, that are an error message or a notice about scripts.
NOTICE_LINES = [
    r"\d{3} ?[-–:] .{0,30}(?:page|access|server|gateway|error|forbidden|denied|not found|unavailable)\b.*", r"HTTP (?:status|error)? ?\d{3}\b.*",
    r"Sorry,? (?:this|the|that|we) (?:page|site|content|could|cannot|can't) .*", r"Oops\b.{0,100}", r"Nothing (?:here|found|to see here)\b.{0,40}", r"The page (?:you (?:asked|were looking) for|cannot be displayed|could not be found)\b.*", r"Page not found\b.*", r"(?:One|Just a) moment(?:,? please)?\b.{0,20}", r"Something went wrong\b.*", r"(?:Redirecting|Loading)(?: to \S+)? ?(?:\.\.\.|…)", r"Please (?:wait|verify|complete)\b.{0,80}(?:human|robot|captcha|browser|moment|seconds?).{0,20}",
    r"Error \d{2,3}\b ?:.*", r"(?:Internal )?Server Error\b.*", r"Service (?:temporarily )?unavailable\b.*", r"Too many requests\b.*", r"(?:Bad|The) gateway (?:did not|timed?)\b.*", r"Gateway time-?out\b.*",
    r"Access (?:to \S+ is |is )?denied\b.*", r"Access to \S+ is (?:denied|forbidden|blocked)\b.*", r"You (?:do not|don't) have permission\b.*",
    r"Session expired\b.*", r"Your session has expired\b.*", r"(?:We are|The site is|Site) (?:currently )?(?:down|offline) for maintenance\b.*",
    r"Database (?:connection )?(?:failed|error)\b.*", r"(?:Fatal|Parse|Syntax) error: .*", r"Warning: .{0,60} on line \d+.*", r"Traceback\b.*", r"Uncaught \w+.*", r"Exception in .*", r"Stack trace:.*",
    r"Checking your browser before .*", r"(?:Please )?(?:enable|turn on|activate) (?:JavaScript|scripts|cookies)\b.*", r"Your browser does not (?:run|support) .*", r"You need to (?:turn on|enable) (?:scripts|JavaScript)\b.*",
    r"This (?:application|page|site|app) (?:requires|needs) (?:JavaScript|scripts)\b.*", r"JavaScript (?:is )?(?:required|disabled)\b.*",
    r"Fehler \d{2,3}\b ?:.*", r"(?:Die )?Seite (?:wurde )?nicht gefunden\b.*", r"Der Dienst ist (?:vorübergehend|derzeit|zurzeit) nicht .*", r"Dienst (?:vorübergehend )?nicht (?:verfügbar|erreichbar)\b.*", r"Zugriff (?:auf \S+ )?verweigert\b.*", r"Wartungsarbeiten\b .{0,30}\d.*", r"Zu viele Anfragen\b.*", r"(?:Ihre )?Sitzung (?:ist )?abgelaufen\b.*",
    r"Diese (?:Anwendung|Seite) (?:benötigt|braucht|erfordert) .{0,20}(?:Skripte|JavaScript|Scripts)\b.*", r"Bitte aktivieren Sie (?:JavaScript|Skripte)\b.*", r"Ihr Browser (?:führt keine|unterstützt kein\w*) .*",
    r"Erreur \d{2,3}\b ?:.*", r"(?:La )?page (?:demandée )?(?:est )?introuvable\b.*", r"Service (?:momentanément|temporairement) indisponible\b.*", r"Accès (?:refusé|interdit)\b.*", r"Site en maintenance\b.*", r"Trop de requêtes\b.*", r"(?:Votre )?session (?:a )?expiré\w*\b.*",
    r"Cette (?:application|page) (?:a besoin de|nécessite) .*(?:scripts|JavaScript)\b.*", r"(?:Veuillez activer|Activez) (?:JavaScript|les scripts)\b.*", r"Votre navigateur n'exécute pas .*", r"Votre navigateur n’exécute pas .*",
    r"Error \d{2,3}: no se .*", r"(?:La )?página (?:no encontrada|solicitada no)\b.*", r"Servicio no disponible\b.*", r"Acceso (?:denegado|prohibido)\b.*", r"Sitio en mantenimiento\b.*", r"Demasiadas (?:solicitudes|peticiones)\b.*", r"(?:Su )?sesión (?:ha )?(?:caducado|expirad)\w*\b.*",
    r"Su navegador no ejecuta .*", r"(?:Active|Activa|Habilite) (?:el )?(?:JavaScript|los scripts)\b.*", r"Esta (?:aplicación|página) (?:necesita|requiere) .{0,40}(?:scripts|JavaScript)\b.*",
    r"Errore \d{2,3}\b ?:.*", r"Pagina non trovata\b.*", r"Servizio (?:momentaneamente |temporaneamente )?non disponibile\b.*", r"Accesso (?:negato|vietato)\b.*", r"Sito in manutenzione\b.*", r"Troppe richieste\b.*", r"Sessione scaduta\b.*",
    r"(?:Attiva|Attivare|Attivi|Abilita) (?:il )?(?:JavaScript|gli script)\b.*", r"Questa (?:applicazione|pagina) (?:richiede|ha bisogno) .{0,40}(?:script|JavaScript)\b.*", r"Il (?:suo|tuo) browser non esegue .*",
    r"Erro \d{2,3}\b ?:.*", r"Página não encontrada\b.*", r"Serviço (?:temporariamente )?indisponível\b.*", r"Acesso (?:negado|proibido)\b.*", r"(?:Sítio|Site) em manutenção\b.*", r"Demasiados pedidos\b.*", r"Sessão expirada\b.*",
    r"(?:Ative|Active|Habilite) o (?:JavaScript|script)\b.*", r"Esta (?:aplicação|página) (?:precisa|requer|necessita) .{0,40}(?:scripts?|JavaScript)\b.*", r"O seu navegador não executa .*",
    r"Fout \d{2,3}\b ?:.*", r"(?:De )?pagina (?:is )?niet gevonden\b.*", r"De dienst is (?:tijdelijk|momenteel) niet .*", r"(?:Geen toegang tot \S+|Toegang geweigerd\b).*", r"(?:De site is in|Site in) onderhoud\b.*", r"Te veel (?:verzoeken|aanvragen)\b.*", r"Sessie verlopen\b.*",
    r"Zet JavaScript aan\b.*", r"Deze (?:toepassing|pagina|app) (?:heeft|vereist) .{0,30}(?:scripts|JavaScript)\b.*", r"(?:Uw|Je) browser (?:voert geen|ondersteunt geen) .*",
    r"Ошибка \d{2,3}\b.*", r"Страница не найдена\b.*", r"(?:Сервис|Служба) (?:временно )?недоступ\w+.*", r"Доступ (?:к \S+ )?(?:запрещён|запрещен)\b.*", r"Включите JavaScript\b.*", r"Слишком много запросов\b.*", r"Для работы .{0,40} JavaScript\b.*",
]
# Titles, as a whole, that are residue.
RESIDUE_TITLES = [
    r"(?:undefined|null|none|NaN|\{\d\}|%s)(?: ?[-–|:] .*)?", r"Untitled(?: document| page| post)?(?: \d+)?", r"New (?:page|post|document|article)(?: \d+)?", r"Lorem ipsum.*", r"(?:Test|Sample|Dummy|Example|Demo|Default) ?(?:page|title|headline|post|article|text|heading)?(?: \d+)?(?: ?[-–|:] .*)?", r"(?:Page|Post|Document) title(?: here)?", r"(?:Your |Insert |Add (?:a )?)?(?:title|headline)(?: goes)?(?: here)?", r"Hello world!?", r"Under construction\b.*", r"Dummy headline\b.*", r"Coming soon", r"(?-i:TODO)\b.*", r"Blindtext.*", r"(?:Loading|Redirecting|Please wait|Checking your browser) ?(?:\.\.\.|…|\.)?", r"(?:Just a|One) moment(?:,? please)? ?(?:\.\.\.|…|\.)?", r"Oops\b.{0,60}", r"Something went wrong\b.{0,40}", r"Sorry\b[,.!]? .{0,50}", r"We(?:'|’)?(?:ll| will) be (?:right )?back\b.{0,40}", r"(?:Attention required|Are you (?:a robot|human)|Verify you are human|Security check|Bot check)\b.{0,40}", r"(?:Nothing here|Nothing found|No content|No title|Missing title|Content unavailable|Temporarily unavailable|Access restricted|Account suspended|Session timed out|Sign in required|Authentication required|Cookies required)", r"This (?:page|site) (?:is|has|does|cannot|can't|needs|requires|could)\b.{0,60}",
    r"\d{3}", r"\d{3} ?[-–:]? ?(?:Not Found|Bad Gateway|Forbidden|Access denied|Internal Server Error|Service Unavailable|Gateway Time-?out|Unauthorized|Bad Request|Gone|Error|Too Many Requests|Page not found)\b.*",
    r"(?:HTTP )?(?:Error|Fehler|Erreur|Errore|Erro|Fout|Ошибка) ?:? ?\d{3}(?: ?[-–|:] .*)?", r"(?:Page|File) not found(?: ?[-–|:] .*)?", r"Not found", r"Log in required\b.*", r"Session expired\b.*", r"Please log in", r"Access denied(?: ?[-–|:] .*)?", r"Forbidden",
    r"(?:Site|Website) (?:offline|down|closed) (?:for|due to) maintenance", r"(?:Under|Down for|Scheduled) maintenance", r"(?:JavaScript|Scripts|Cookies) (?:is |are )?(?:required|disabled)", r"(?:Please )?(?:enable|turn on|activate) (?:JavaScript|scripts|cookies)\b.{0,40}", r"Service (?:temporarily )?unavailable", r"(?:Internal )?[Ss]erver [Ee]rror", r"Too many requests",
    r"(?:Sans titre|Nouvelle page|Titre ici|Un instant|Veuillez patienter|Chargement|Oups)\b.{0,30}", r"Accès (?:refusé|interdit)(?: ?[-–|:] .*)?", r"Page (?:introuvable|non trouvée)(?: ?[-–|:] .*)?", r"Connexion requise", r"Session expirée", r"Erreur (?:du )?serveur", r"Site en maintenance", r"Service indisponible", r"JavaScript requis",
    r"(?:Unbenannt\w*|Ohne Titel|Neue Seite|Titel hier|Einen Moment|Bitte warten|Wird geladen|Hoppla)\b.{0,30}", r"Zugriff verweigert(?: ?[-–|:] .*)?", r"Seite nicht gefunden(?: ?[-–|:] .*)?", r"Sitzung abgelaufen", r"JavaScript erforderlich", r"Serverfehler", r"Dienst nicht (?:verfügbar|erreichbar)", r"Wartungsarbeiten", r"Wartung", r"Anmeldung erforderlich",
    r"(?:Sin título|Nueva página|Título aquí|Un momento|Espere|Cargando|Vaya)\b.{0,30}", r"Acceso (?:denegado|prohibido)(?: ?[-–|:] .*)?", r"Página no encontrada(?: ?[-–|:] .*)?", r"Sesión (?:caducada|expirada)", r"Error del servidor", r"Sitio en mantenimiento", r"Servicio no disponible",
    r"(?:Senza titolo|Nuova pagina|Titolo qui|Attendere|Caricamento)\b.{0,30}", r"Accesso negato(?: ?[-–|:] .*)?", r"Pagina non trovata(?: ?[-–|:] .*)?", r"Sessione scaduta", r"Errore del server", r"Sito in manutenzione", r"Servizio non disponibile",
    r"(?:Sem título|Nova página|Título aqui|Aguarde|Carregando|A carregar)\b.{0,30}", r"Acesso negado(?: ?[-–|:] .*)?", r"Página não encontrada(?: ?[-–|:] .*)?", r"Sessão expirada", r"Erro do servidor", r"(?:Site|Sítio) em manutenção", r"Serviço indisponível",
    r"(?:Naamloos|Zonder titel|Nieuwe pagina|Titel hier|Een ogenblik|Even geduld|Laden)\b.{0,30}", r"(?:Toegang geweigerd|Geen toegang)(?: ?[-–|:] .*)?", r"Pagina niet gevonden(?: ?[-–|:] .*)?", r"Sessie verlopen", r"Serverfout", r"Site in onderhoud",
    r"Доступ запрещ[её]н", r"Страница не найдена",
]
# --- end of fixed values ----------------------------------------------------

_NAME = r"[A-Za-z_][\w]*(?:[.\[\]'\w]*\w)?"
_FIELD = r"(?:[A-Za-z]+[._][\w.]+|[a-z]+[A-Z]\w*|[A-Z][A-Z_]{2,}|(?i:" + "|".join(FIELD_NAMES) + r"))"
_PLACEHOLDERS = [
    ("{{", re.compile(r"(?<!`)\{\{\s*[\w.$|' -]{1,40}?\s*\}\}(?!`)")),
    ("{%", re.compile(r"(?<!`)\{%-?\s*[\w.='\" -]{1,60}?\s*-?%\}(?!`)")),
    ("${", re.compile(r"(?<!`)\$\{\s*" + _NAME + r"\s*\}(?!`)")),
    ("#{", re.compile(r"(?<!`)#\{\s*" + _NAME + r"\s*\}(?!`)")),
    ("[[", re.compile(r"(?<!`)\[\[\s*" + _NAME + r"\s*\]\](?!`)")),
    ("<%", re.compile(r"(?<!`)<%[=-]?\s*" + _NAME + r"\s*-?%>(?!`)")),
    ("<?", re.compile(r"(?<!`)<\?(?:=|php)?\s*(?:echo\s+)?\$?" + _NAME + r"\s*;?\s*\?>(?!`)")),
    ("@@", re.compile(r"(?<!`)@@" + _NAME + r"@@(?!`)")),
    ("__", re.compile(r"(?<![`\w])__[A-Za-z][\w.]{1,30}?__(?![`\w])")),
    ("%", re.compile(r"(?<![`\w%])%" + _FIELD + r"%(?![`\w%])")),
    ("&lt;", re.compile(r"(?<!`)&lt;/?\s*" + _FIELD + r"\s*/?&gt;(?!`)")),
    ("[", re.compile(r"(?<![`\[\w])\[" + _FIELD + r"\](?![`\](\[:])")),
    ("{", re.compile(r"(?<![`{$#\w])\{(?:" + _FIELD + r"|\d)\}(?![`}\w])")),
]
_FILLER = re.compile("(?:" + "|".join(FILLER_LINES) + r")\Z", re.I)
_NOTICE = re.compile("(?:" + "|".join(NOTICE_LINES) + r")\Z", re.I)
_TITLE = re.compile("(?:" + "|".join(RESIDUE_TITLES) + r")\Z", re.I)
_LOREM_HINT = re.compile(r"\b(?:dolor|lorem|ipsum|aliqua|consectetur|adipiscing|veniam|nostrud|ullamco|cillum|fugiat|eiusmod|occaecat|cupidatat|proident|laboris|commodo|excepteur|incididunt)\b", re.I)
_LATIN = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"[^\W\d_]{3,}")
_SENTENCE = re.compile(r"[.!?…]\s")
LONGEST_NOTICE = 160  # characters of a notice of one or two short sentences; of longer lines the first sentence decides


def placeholders(text: str) -> bool:
    """Whether a text holds an unfilled placeholder.  A placeholder between
    backticks is quoted, not unfilled."""
    return any(sign in text and pattern.search(text) for sign, pattern in _PLACEHOLDERS)


def lorem(line: str) -> bool:
    """Whether a line is the usual filler in Latin words."""
    if _LOREM_HINT.search(line):
        words = _LATIN.findall(line.lower())
        return len(words) >= 3 and sum(w in LOREM for w in words) >= 0.75 * len(words)
    return False


def _first_sentences(line: str) -> str:
    """A line of up to `LONGEST_NOTICE` characters, of a longer one the sentences
    that begin within them."""
    if len(line) <= LONGEST_NOTICE:
        return line
    ends = [m.end() for m in _SENTENCE.finditer(line, 0, LONGEST_NOTICE)]
    return line[: ends[0]].rstrip() if ends else ""


def filler(line: str) -> bool:
    """Whether a stripped line is filler text.  A line that is longer than a
    notice counts by its first sentence."""
    return _FILLER.match(_first_sentences(line)) is not None or lorem(line)


def notice(line: str) -> bool:
    """Whether a stripped line is an error message or a notice about scripts.  A
    line that is longer than a notice counts by its first sentence."""
    return _NOTICE.match(_first_sentences(line)) is not None


def residue_text(text: str) -> bool:
    """Whether a text is residue wholly or in places, by placeholders or the lists
    of wordings."""
    return placeholders(text) or any(notice(line) or filler(line) for line in map(str.strip, text.split("\n")) if line)


def residue_title(title: str) -> bool:
    """Whether a title is residue."""
    title = title.strip()
    return placeholders(title) or _TITLE.match(title) is not None or (_LOREM_HINT.search(title) is not None and filler(title))


def only_notice(body: list[str]) -> bool:
    """Whether the stripped body lines of a page are nothing but error notices,
    apart from one heading."""
    told = [notice(line) for line in body]
    return any(told) and all(t or (i == 0 and title_like(line)) for i, (t, line) in enumerate(zip(told, body)))


# --- combined evidence ------------------------------------------------------
MANY_URLS, MANY_HOSTS = 5, 3  # addresses and hosts of a wording that comes back everywhere
MISMATCHED_SHARE = 0.8  # share of a wording's rows that must be mismatched
CONTENT_RATE = 0.2  # share of a title term's pages whose body has it, from which it is a word of content
LINE_TERMS = 2  # terms of a line that can be told to be mismatched

_ADDRESS = re.compile(r"\S*\w\.(?:[a-z]{2,}|[a-z]+/)\S*")

_MASK = re.compile(r"\S*\w\.(?:[a-z]{2,}|[a-z]+/)\S*|\b(?=\w*\d)\w+\b|(?<!^)(?<![.!?] )\b[A-Z]\w*(?: [A-Z]\w*)*")


def _wording_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(_MASK.sub("0", text).lower().encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def terms_of(text: str, common: frozenset[str]) -> set[str]:
    """Words of three letters and more, lower case, without the common ones."""
    return {w for w in _WORD.findall(text.lower()) if w not in common}


def mismatched_response(body: list[str], known: set[str], common: frozenset[str]) -> list[str]:
    """The lines of a body of little information: sentences, apart from a heading
    before them, none of which has a term in common with `known` or with another
    line.  A body with any other line gives none; repeated lines count once."""
    lines = list(dict.fromkeys(body))
    if len(lines) > 1 and title_like(lines[0]):
        lines = lines[1:]
    seen = set(known)
    for line in lines:
        terms = terms_of(_ADDRESS.sub(" ", line), common)
        if len(terms) < LINE_TERMS or terms & seen or "`" in line or line_form(line) != PROSE:
            return []
        seen |= terms
    return lines


EVIDENCE = "tbl string, row_id long, hit boolean, wording long, mismatched boolean, url string, terms array<string>, matched array<boolean>"
_EVIDENCE = pa.schema([
    ("tbl", pa.string()), ("row_id", pa.int64()), ("hit", pa.bool_()), ("wording", pa.int64()), ("mismatched", pa.bool_()), ("url", pa.string()),
    ("terms", pa.list_(pa.string())), ("matched", pa.list_(pa.bool_())),
])


def _title_evidence(tbl, row_id, url, title, text, common, lists):
    """The title against slug and body of its page."""
    if title is None:
        return
    hit = placeholders(title) or lorem(title) or (lists and residue_title(title))
    terms = sorted(terms_of(title, common))
    slug = (url or "").partition("://")[2].partition("/")[2].lower()
    # the title as a line of the body does not speak for itself
    named = title.strip().lower()
    lines = (text or "").lower().split("\n")
    body = "\n".join(line for line in lines if line.strip() != named)
    # the first letters of a word: other forms of it match, too
    matched = [t[:6] in body or t[:6] in slug for t in terms]
    yield tbl, row_id, hit, _wording_hash(title) if terms else None, not any(matched) and len(body) == sum(map(len, lines)) + len(lines) - 1, url, terms, matched


def _text_evidence(tbl, row_id, url, title, text, common, lists):
    """The body against slug and title."""
    text = text or ""
    if residue_text(text) if lists else placeholders(text) or any(map(lorem, map(str.strip, text.split("\n")))):
        yield tbl, row_id, True, None, False, None, None, None
        return
    lines = text.split("\n")
    body = [s for line, f in zip(lines, furniture_flags(lines, title)) if not f and (s := line.strip())]
    slug = (url or "").partition("://")[2].partition("/")[2]
    for line in mismatched_response(body, terms_of(slug, common) | terms_of(title or "", common), common):
        yield tbl, row_id, False, _wording_hash(line), True, url, None, None


def residue(documents: DataFrame, common: frozenset[str] = frozenset(), lists: bool = True) -> DataFrame:
    """(tbl, row_id) of the rows that are residue.

    `documents` has (tbl, row_id, url, title, text); of `indexed_pages` the title
    decides, of all other tables the text.  A null title or text is none.
    `common` are words that are no terms.  With `lists` false the lists of
    notices, filler lines and titles are not used: placeholders, Latin filler and
    host evidence alone decide.
    """

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                found += (_title_evidence if row[0] == "indexed_pages" else _text_evidence)(*row, common, lists)
            columns = list(zip(*found)) if found else [()] * len(_EVIDENCE)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EVIDENCE.types)], schema=_EVIDENCE)

    columns = documents.select("tbl", F.col("row_id").cast("long"), "url", "title", "text")
    told = staged(columns.mapInArrow(evidence, EVIDENCE), "residue")
    of_titles = F.col("tbl") == "indexed_pages"
    repeated = (
        told.where("wording is not null").groupBy(of_titles.alias("of_title"), "wording").agg(
            F.approx_count_distinct("url").alias("urls"), F.approx_count_distinct(host_of(F.col("url"))).alias("hosts"),
            F.avg(F.col("mismatched").cast("double")).alias("share"),
        )
        .where((F.col("urls") >= MANY_URLS) & (F.col("hosts") >= MANY_HOSTS) & (F.col("share") >= MISMATCHED_SHARE))
        .select("of_title", "wording")
    )
    suspects = told.where("mismatched and not hit").withColumn("of_title", of_titles).join(repeated, ["of_title", "wording"], "left_semi")
    rates = (
        told.where(of_titles).select(F.explode(F.arrays_zip("terms", "matched")).alias("x"))
        .groupBy(F.col("x.terms").alias("term")).agg(F.avg(F.col("x.matched").cast("double")).alias("rate"))
    )
    titles = suspects.where("of_title").select("tbl", "row_id", F.explode("terms").alias("term")).join(rates, "term").groupBy("tbl", "row_id").agg(F.max("rate").alias("rate"))
    parts = [told.where("hit"), suspects.where("not of_title"), titles.where(F.col("rate") < CONTENT_RATE)]
    return parts[0].select("tbl", "row_id").unionByName(parts[1].select("tbl", "row_id").distinct()).unionByName(parts[2].select("tbl", "row_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(stored_texts(spark, sf_dir), common_words(spark, sf_dir))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
