"""Recognising lines of site furniture by their wording.

Site furniture is what a site puts around a page: menus, breadcrumbs, consent
notices, prompts to share or subscribe, advertisement marks, page tools, tag
lines, blocks of related titles and legal footers.  `furniture_flags` labels
the lines of one page.  It is the slot-typing half of the template operator
(`boilerplate.py`) and the body filter of the operators that only look at the
main text of a page.

Everything here is plain Python over one page at a time and runs inside Arrow
batches; nothing keeps state between pages except a bounded cache of short
lines.
"""

from __future__ import annotations

import re
from functools import lru_cache

# --- fixed values -----------------------------------------------------------
# Menu entries, by language.
MENU_WORDS = """
Home|News|Log in|Login|Sign in|Topics|Archive|About us|About|Careers|Jobs|Gallery|Shop|Support|Products|Events|Search|Contact|Contact us|Help|Menu|Sitemap
Suche|Über uns|Startseite|Termine|Produkte|Anmelden|Themen|Hilfe|Kontakt|Archiv|Karriere|Aktuelles|Veranstaltungen|Nachrichten|Galerie
Emplois|Actualités|Aide|À propos|Produits|Connexion|Recherche|Archives|Accueil|Thèmes|Événements|Boutique
Temas|Entrar|Contacto|Empleo|Inicio|Noticias|Buscar|Productos|Ayuda|Quiénes somos|Archivo|Eventos|Tienda|Iniciar sesión
Aiuto|Inizio|Notizie|Chi siamo|Accedi|Prodotti|Contatti|Cerca|Archivio|Temi|Lavora con noi|Eventi|Negozio
Notícias|Quem somos|Arquivo|Início|Pesquisar|Produtos|Ajuda|Emprego|Loja|Contactos
Hulp|Zoeken|Nieuws|Onderwerpen|Inloggen|Over ons|Start|Producten|Archief|Vacatures|Winkel|Agenda
Главная|Новости|Войти|Темы|Архив|О нас|Контакты|Продукты|Поиск|Помощь|Вакансии|События|Магазин|Галерея|Начало|Товары
"""
# Entries of legal footers and of page stepping, by language.
LEGAL_WORDS = """
Imprint|Privacy|Terms of use|Terms|Legal notice|Accessibility|Privacy policy|Cookie policy|Cookies
Impressum|Datenschutz|AGB|Barrierefreiheit
Mentions légales|Confidentialité|Accessibilité
Aviso legal|Privacidad|Accesibilidad
Note legali|Accessibilità
Privacidade|Acessibilidade
Colofon|Toegankelijkheid|Voorwaarden
Выходные данные|Конфиденциальность|Правила
"""
STEP_WORDS = """
Previous|Next|Back|Zurück|Weiter|Précédent|Suivant|Anterior|Siguiente|Seguinte|Próximo|Indietro|Avanti|Precedente|Successivo|Vorige|Volgende|Назад|Вперёд|Далее
"""
# Answers of consent notices.
CHOICE_WORDS = """
Accept all|Accept|Reject|Reject all|Settings|OK|Got it|Manage options|Decline|I agree|Agree
Alle akzeptieren|Zustimmen|Ablehnen|Einstellungen|Akzeptieren
Tout accepter|Accepter|Refuser|Gérer mes choix|Tout refuser
Aceptar todo|Aceptar|Rechazar|Configurar|Gestionar opciones
Accetta tutto|Accetta|Rifiuta|Gestisci opzioni|Impostazioni
Aceitar tudo|Aceitar|Recusar|Gerir opções
Akkoord|Weigeren|Alles accepteren|Instellingen|Alles toestaan
Принять все|Принять|Отклонить|Настройки
"""
# Headings of blocks of related or most-read titles.
RELATED_HEADINGS = """
Most read|You may also like|Related articles|Read next|Read more|See also|Recommended
Meistgelesen|Verwandte Artikel|Das könnte Sie auch interessieren|Lesen Sie auch
Articles liés|Les plus lus|À lire aussi
Lo más leído|Artículos relacionados|Le puede interesar|Lea también
I più letti|Articoli correlati|Leggi anche
Mais lidos|Artigos relacionados|Leia também
Meest gelezen|Gerelateerde artikelen|Lees ook
Самое читаемое|Похожие статьи|Читайте также
"""
RELATED_FROM = r"(?:More from|Mehr von|Plus sur|Plus de|Más de|Altro da|Altri articoli di|Ancora da|Mais de|Mais sobre|Meer van|Ещё от|Больше от) \S.{0,60}"
# Whole lines, as regular expressions over the stripped line.
WHOLE_LINES = [
    # legal and contact footers
    r"©.*", r"\(c\) \d{4}.*", r"Copyright (?:©|\d{4}).*",
    r"Legal notice\. Privacy policy\. Accessibility\.",
    r"(?:Contact|Kontakt|Anschrift|Adresse|Dirección|Direccion|Indirizzo|Sede|Morada|Endereço|Adres|Адрес|Address|Contatti|Contatto|Contacto|Контакты) ?: .{0,120}(?:\S+@\S+|\d{3}).{0,40}",
    r"[^.!?]{0,60}(?:All rights reserved|Alle Rechte vorbehalten|Tous droits réservés|Tutti i diritti riservati|Todos os direitos reservados|Todos los derechos reservados|Alle rechten voorbehouden|Все права защищены)\.?",
    # consent notices
    r"Your privacy choices: .*", r"(?:We|Wir|Nous|Nosotros|Noi|Nós|Wij|Мы) (?:and|und|et|y|e|en|и) \d+ (?:partners?|Partner|partenaires|socios|parceiros|партн\w+) .*",
    r"This page asks for your consent before .*", r"By (?:staying on|using) .{1,60} you agree to .*cookies.*",
    r"Cookies help .{1,60} remember .*", r".{1,60} stores small files on your device .*",
    r".{1,60} (?:verwendet|nutzt) Cookies, .*", r"Ihre Einwilligung gilt für alle Seiten von .*",
    r".{1,60} utilise des cookies pour .*", r"Votre accord vaut pour toutes les pages de .*",
    r".{1,60} (?:usa|utiliza) cookies para .*", r"(?:Su permiso|Su consentimiento) vale para todas las páginas de .*",
    r".{1,60} usa i cookie per .*", r"Il (?:Suo|tuo|suo|vostro) consenso vale per tutte le pagine di .*",
    r"(?:O seu consentimento|A sua autorização|O seu acordo|A sua permissão) (?:vale|é válid[oa]) para todas as páginas d[aeo] .*",
    r".{1,60} gebruikt cookies om .*", r"Uw toestemming geldt voor alle pagina's van .*", r"Uw toestemming geldt voor alle pagina’s van .*",
    r".{1,60} использует (?:cookie|файлы cookie).*", r"Ваше согласие действует .*",
    r"(?:We use|This site uses|This website uses) cookies.*",
    # sharing, subscribing, logging in, jumping
    r"(?:Share this page|Share this|Share on)\b.{0,60}", r"(?:Seite teilen|Diese Seite teilen|Teilen)(?::.{0,60})?", r"Partager cette page.{0,60}",
    r"Compartir esta página.{0,60}", r"Condividi (?:questa )?pagina.{0,60}", r"Partilhar esta página.{0,60}", r"Compartilhar esta página.{0,60}",
    r"Deel deze pagina.{0,60}", r"Поделиться(?: страницей)?.{0,60}",
    r"(?:Follow|Subscribe to) .{1,60}", r"(?:Newsletter von .{1,60} abonnieren|Den Newsletter .{1,60})", r"Folgen Sie .{1,60}",
    r"S['’]abonner à .{1,60}", r"Suivez .{1,50}", r"Suscríbase (?:al|a la) .{1,60}", r"Siga a .{1,50}", r"Iscriviti alla newsletter .{1,60}", r"Segui .{1,40} (?:per|su) .{1,40}",
    r"Assine o (?:boletim|newsletter) .{1,60}", r"Abonneer u op .{1,60}", r"Volg .{1,40} (?:voor|op) .{1,40}", r"Подпи(?:сать|ши)\w* .{1,60}",
    r"Log in to .{0,40}comment.{0,20}", r"(?:Zum Kommentieren anmelden|Anmelden,? um zu kommentieren)", r"Se connecter pour commenter|Connectez-vous pour commenter",
    r"Inicie sesión para comentar", r"Accedi per commentare", r"(?:Entre|Inicie sessão|Entrar) para comentar", r"(?:Log in|Inloggen) om te reageren|Inloggen om te reageren|Meld u aan om te reageren", r"Войдите, чтобы .{1,30}",
    r"(?:Back to top|Top of page|Skip to (?:main )?content|Jump to content|Skip navigation)", r"Nach oben|Zum (?:Seitenanfang|Inhalt springen|Inhalt)", r"(?:Haut de page|Retour en haut|Aller au contenu)",
    r"(?:Volver arriba|Ir arriba|Ir al contenido|Saltar al contenido)", r"(?:Torna su|Torna all'inizio|Vai al contenuto|Salta al contenuto)", r"(?:Voltar ao topo|Ir para o (?:conteúdo|topo)|Saltar para o conteúdo)", r"(?:Naar boven|Terug naar boven|Naar de inhoud|Ga naar de inhoud)", r"(?:Наверх|Перейти к содержанию|К началу)",
    # advertisement marks
    r"(?:Advertisement|Sponsored|Ad|Advertising|Anzeige|Werbung|Publicité|Publicidad|Anuncio|Pubblicità|Annuncio|Publicidade|Advertentie|Reclame|Реклама)",
    # page tools and counters
    r"Print version of .{1,60}", r"(?:Page views|Views): ?\d+.{0,40}", r"Rate this page", r"Druckversion(?: von)? .{1,60}", r"(?:Version imprimable|Imprimer) .{0,60}", r"Versión (?:para imprimir|imprimible) .{1,60}", r"Versione stampabile .{1,60}", r"Versão para (?:imprimir|impressão) .{1,60}", r"(?:Afdrukversie|Printversie) .{1,60}", r"Версия для печати.{0,60}",
    r"\d+ (?:comments?|Kommentare?|commentaires?|comentarios?|commenti|commento|comentários?|reacties?|комментари\w*)", r"(?:Comments|Kommentare|Commentaires|Comentarios|Commenti|Comentários|Reacties) ?[:(] ?\d+\)?",
    r"(?:Reading time|Lesezeit|Temps de lecture|Tiempo de lectura|Tempo di lettura|Tempo de leitura|Leestijd|Время чтения) ?: ?\d+.{0,20}",
    r"\d+ (?:minutes? read|min read|Minuten Lesezeit|min de lecture|min de lectura|minuti di lettura|min de leitura|minuten lezen)",
    # tag lines
    r"(?:Tags?|Schlagwörter|Stichwörter|Mots-clés|Mots clés|Étiquettes|Etiquetas|Etichette|Parole chiave|Palavras-chave|Trefwoorden|Labels|Метки|Теги) ?: .{1,120}",
]
# --- end of fixed values ----------------------------------------------------


def _words(block: str) -> frozenset[str]:
    return frozenset(w.strip().lower() for w in re.split(r"[|\n]", block) if w.strip())


MENU = _words(MENU_WORDS)
LEGAL = _words(LEGAL_WORDS)
STEP = _words(STEP_WORDS)
CHOICE = _words(CHOICE_WORDS)
RELATED = _words(RELATED_HEADINGS)
_ENTRY = MENU | LEGAL | STEP | CHOICE
_WHOLE = re.compile("(?:" + "|".join(WHOLE_LINES) + r")\Z")
_RELATED_FROM = re.compile(RELATED_FROM + r"\Z")
_SPLIT = re.compile(r" ?\| ?| {2,}| ?> ?| ?› ?| ?» ?| ?· ?| ?/ ?|, | - ")
_BULLET = re.compile(r"[*\-•·–] +")
_NO_TITLE = re.compile(r"[|\t@;,\d#\[\]]|http|  ")
_SENTENCE_END = tuple(".!?…\"”“»)'’:;")

BODY, FURNITURE, RELATED_HEAD = 0, 1, 2
LEAST_RELATED = 2  # titles a related block has at least


@lru_cache(maxsize=65536)
def wording(line: str) -> int:
    """Label of one stripped, non-blank line of at most 200 characters: body,
    furniture, or the heading of a block of related titles."""
    low = line.lower()
    if low in RELATED or _RELATED_FROM.match(line):
        return RELATED_HEAD
    core = line
    m = _BULLET.match(line)
    if m:
        core = line[m.end():]
    low = core.lower().rstrip(":")
    if low in _ENTRY:
        return FURNITURE
    if len(core) <= 160:
        parts = [p for p in _SPLIT.split(low) if p]
        if len(parts) > 1:
            known = sum(p in _ENTRY for p in parts)
            # a footer may name its publisher among legal entries
            if known == len(parts) or (known >= 2 and known == len(parts) - 1 and any(p in LEGAL for p in parts)):
                return FURNITURE
            if known == 1 and len(parts) == 2 and parts[1] in LEGAL and "|" in core:
                return FURNITURE
    return FURNITURE if not m and _WHOLE.match(line) else BODY


def title_like(line: str, longest: int = 80, most_words: int = 11) -> bool:
    """Whether a line can be an entry of a related block: a few words that begin
    with a capital, no sentence, no mark of an entry or a cell."""
    if len(line) > longest or line.endswith(_SENTENCE_END):
        return False
    blanks = line.count(" ")
    if blanks >= most_words or not (blanks or "'" in line or "’" in line) or not (line[0].isupper() or line[0] in "«“\""):
        return False
    return not _NO_TITLE.search(line)


def furniture_flags(lines: list[str], title: str | None = None, template: list[bool] | None = None) -> list[bool]:
    """One flag per line, True for site furniture; blank lines are False.

    `lines` are the raw lines; those `template` marks are furniture already, and
    only the others are typed by their wording.  The lists know lines of up to
    200 characters; longer furniture is found by the host's template.  A related
    block is its heading and the title-like lines after it; it ends by form: at a
    blank line, at a sentence, at any other furniture and, after the first
    `LEAST_RELATED`, at the page's own title.  An empty page gives an empty list.
    """
    out = [False] * len(lines)
    taken = -1  # titles of the related block so far; -1 outside of one
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            taken = -1
            continue
        kind = wording(line) if len(line) <= 200 else BODY
        if kind == RELATED_HEAD:
            out[i] = True
            taken = 0
        elif kind == FURNITURE or (template and template[i]):
            out[i] = True
            # a title that the template knows does not end a block of titles
            taken = taken + 1 if taken >= 0 and kind == BODY and title_like(line) else -1
        elif taken >= 0:
            # the page's own title may be among the related ones, but not after the block
            if title_like(line) and (line != title or taken < LEAST_RELATED):
                out[i] = True
                taken += 1
            else:
                taken = -1
    return out
