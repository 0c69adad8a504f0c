"""Template residue, filler, error pages and script notices.

1. Lines are normalised (markup and list marks off, lower case; digits as 0 where the line holds evidence) and counted
   per host over all different texts.
2. Lines in at least ``furniture`` of a host's different texts are its recurrent boilerplate (a line of a single text
   recurs nowhere) and are subtracted, filler, errors and notices among them too where they stand in a passage with other
   lines. Never subtracted are placeholders, evidence that makes up a passage (lines between blank ones, a list item, a
   chat message, a block of HTML), and evidence beside which the document has nothing but boilerplate.
3. A document is excluded when its residual lines hold evidence: an unfilled placeholder, filler, an error page or a
   script notice. Code (fenced, inline, or by its form), quotations and sentences that speak of such things are none.

Scale: lines are reduced to 64-bit hashes in Arrow batches; only the lines of documents whose evidence may be
subtracted are compared with the boilerplate.
Counts are keyed on (host, line), so a host with a third of all documents is spread over its lines.

Defined results: null, empty and blank texts hold no evidence and stay; a null host is a host of its own; repeated rows
count and are each excluded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import cut

#: A line is boilerplate in at least this share of a host's different texts.
FURNITURE = 0.5

#: Fenced code; a fence that is never closed ends at the next blank line, so that what follows is read.
_FENCE = re.compile(r"```(?:(?!```).)*```|```.*?(?=\n\s*\n|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_LEAD = re.compile(r"^(?:\s|[>*•–-]\s|\d{1,3}[.)]\s|\[\d\d:\d\d\]\s*<[^<>\n]{1,40}>|\d\d:\d\d\s+[^\s:]{1,40}(?: [^\s:]{1,40})?:\s|<(?:p|div|br|li|td|tr|body|html|head|hr|noscript|h\d)\b[^>]*>)+", re.I)
_BLOCKS = re.compile(r"</?(?:p|div|br|li|ul|ol|td|tr|table|body|html|head|title|hr|noscript|h[1-6]|main|section|footer|header|nav)\b[^>]*>", re.I)
_TAGS = re.compile(r"</?(?:p|div|br|li|ul|ol|td|tr|table|body|html|head|title|hr|noscript|h[1-6]|b|i|em|strong|span|a|u|font|center|pre|code|main|section|footer|header|nav)\b[^>]*>", re.I)
_CODE = re.compile(
    r"^\s*(?:export|SELECT|INSERT|UPDATE|DELETE|import|from|def|class|return|for|while|if|elif|else|try|except|with|print|printf|echo|ls|cd|curl|git|npm|pip|sudo|const|let|var|function|public|private|#include)\b[^.!?]*[(){}=|;:\[\]$]"
    r"|^\s*[A-Za-z_][\w.]*\s*(?:\+|-)?=\s*\S|\w\([^()]*\)\s*(?:;|\{|$)|&&|\|\||^\s*[{\[]\s*\"|;\s*$|^\s*(?://|/\*|--\s)|\b[a-z_]+\(\"[^\"]*\""
)
#: A name as templates write it: words of letters, joined by blanks, underscores, dots or dashes.
_FIELD = r"[^\W\d_]{2,}(?:[ _.\-][^\W\d_]{1,}){0,4}"
_PLACEHOLDERS = re.compile(
    rf"\{{\{{\s*[#/^&>]?\s*{_FIELD}\s*\}}\}}|\[\[\s*{_FIELD}\s*\]\]|@@\s*{_FIELD}\s*@@|%%\s*{_FIELD}\s*%%|\*\|\s*{_FIELD}\s*\|\*|<%[=-]?\s*{_FIELD}\s*%>|\{{%\s*{_FIELD}\s*%\}}"
    rf"|\$\{{\s*{_FIELD}\s*\}}|<<\s*{_FIELD}\s*>>|(?<![\w_])__{_FIELD}__(?![\w_])|(?<!\w)#[A-Z][A-Z_]{{2,}}#(?!\w)|(?<![\w$])\$[A-Z][A-Z_]{{2,}}\$(?![\w$])"
    rf"|\((?:TBD|TBA|TODO|TBC)\s*:\s*{_FIELD}\)|\[(?:insert|hier|insérer|insertar|enter|your|ihr|votre|su|add|fill in|placeholder)\b[^\[\]\n]{{1,50}}\]|\[{_FIELD} (?:einfügen|here|eintragen|aquí|ici)\]"
    rf"|<(?:your|insert|ihr|votre|su|enter)\s[^<>\n]{{1,50}}>|<{_FIELD} (?:here|einfügen|ici|aquí)>"
    rf"|(?<!\w)X{{2,}}\.X{{2,}}\.X{{2,}}(?!\w)|(?<![\w%])%(?:s|d|\d\$s|\([a-z_]+\)s)(?![\w])|(?<![\w{{$])\{{\d{{1,2}}\}}(?![\w}}])|(?<![\w{{$])\{{{_FIELD}\}}(?![\w}}])",
    re.I,
)
#: What every placeholder holds.
_MARKS = re.compile(r"[{\[<%$#@*]|__|\(T|X\.X", re.I)
_STRICT_CASE = re.compile(r"^(?:#|\$[A-Z])")
_BRACKET = re.compile(r"\[[A-Z][^\W\d_]+(?: [A-Z]?[^\W\d_]+){0,3}\]")
#: A field in angle brackets: of two words or more, or one of the usual names of fields (``<guid>`` in prose is none).
_ANGLE = re.compile(r"<(?:[a-zà-ÿ]+(?: [a-zà-ÿ]+){1,3}|(?:first|last|full|user|team|room|host|file|project|company|customer|client|meeting)?_?(?:name|date|time|room|topic|agenda|channel|organi[sz]er|title|team|link|host|subject|sender|recipient|company|customer|client|address|amount|location|place|day|month|year|user|owner|department|project|number|datum|uhrzeit|raum|thema|ort|nom|lieu|salle|sujet|fecha|hora|nombre|lugar|sala|tema))>")
_QUOTES = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»|‘[^’\n]{1,200}’|(?<!\w)'[^'\n]{2,200}'(?!\w)")

#: Words of filler and of keyboard tests.
LATIN = set("lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
LATIN_SURE = LATIN - set("do in ex ad id est non et sit ea eu ut qui sed a".split())
KEYS = set("xxx xx xxxx asdf asdfasdf asdfgh qwer qwert qwerty qwertz yxcv jkl jklö foo bar baz blah bla blub blubb test tests text texte texto dummy sample placeholder filler abc abcd aaa bbb zzz hjkl tbd todo".split())
_SLIDE = re.compile(
    r"(?:click (?:here )?to (?:add|edit)\b.*|enter (?:your )?text(?: here)?|add (?:your )?(?:text|title|details|subtitle|notes|content|description)(?: here)?|(?:your|insert|type|write) (?:your )?(?:text|title|content|name|subtitle) (?:goes )?here\b.*|text (?:goes )?here|subtitle|description|heading \d+|column \d+|bullet \d+|item \d+|title \d+|placeholder(?: text)?|"
    r"(?:this is )?(?:a )?(?:sample|dummy|placeholder) text\b.*|(?:hier|bitte) (?:text|titel) (?:einfügen|eingeben)\b.*|(?:titel|text) hinzufügen\b.*|blindtext|mustertext|untertitel|überschrift \d+|spalte \d+|cliquez pour (?:ajouter|modifier)\b.*|(?:saisir|saisissez|insérer|ajouter) (?:du |votre |le |un )?(?:texte|titre)\b.*|texte? d'exemple|sous-titre|haga clic para\b.*|(?:escriba|inserte|añada|agregue) (?:aquí |su |el |un )?(?:texto|título)\b.*|texto de (?:ejemplo|relleno)|subtítulo|placeholder paragraph|type (?:something|anything|here)(?: here)?|(?:your|some) (?:content|text|title|name) (?:goes )?here|write (?:something|here)|votre (?:texte|titre|nom) ici|(?:écrivez|tapez|saisissez) (?:ici|quelque chose)|(?:escriba|escribe|teclee) (?:aquí|algo)|(?:su|tu) (?:texto|título|nombre) aquí|(?:ihr|dein) (?:text|titel|name)(?: hier)?|(?:schreiben sie|schreibe) (?:hier|etwas)|(?:il tuo|inserisci(?: il)?) testo(?: qui)?|(?:seu|o seu) texto aqui|(?:uw|jouw) tekst hier|(?:dies|das|hier) ist (?:ein |nur )*(?:blindtext|platzhalter|mustertext)\b.*|hier (?:könnte|steht|kommt) (?:ihr|dein|der|später)\b.*text\b.*|ceci est un (?:faux )?texte\b.*|este es un texto de\b.*)[.…!]*",
    re.I,
)
_SCRIPT_WORD = r"(?:java ?script|js|scripts?|scripting)"
_SCRIPT = re.compile(
    rf"\b(?:please |bitte |veuillez |por favor,? )?(?:enable|activate|turn on|switch on|allow|permit|unblock) (?:\w+ ){{0,2}}{_SCRIPT_WORD}\b|\b{_SCRIPT_WORD} (?:is|are|has been|must be|needs to be|seems to be|appears to be) (?:\w+ ){{0,2}}(?:disabled|blocked|off|required|needed|enabled|turned|switched|unavailable|deactivated)\b"
    rf"|\b(?:requires?|needs?|works only with|works? properly without|does not work (?:\w+ )?without|doesn't work (?:\w+ )?without) (?:\w+ ){{0,2}}{_SCRIPT_WORD}\b|\bdoes not support (?:\w+ )?{_SCRIPT_WORD}\b|\byou need to enable\b.*{_SCRIPT_WORD}"
    rf"|\b(?:benötigt|braucht|erfordert|aktivieren sie) (?:\w+ ){{0,2}}{_SCRIPT_WORD}\b|\b{_SCRIPT_WORD} (?:ist|wurde|muss) (?:\w+ ){{0,2}}(?:deaktiviert|blockiert|aktiviert|ausgeschaltet|eingeschaltet)\b|\b(?:activer|activez|autoriser|autorisez) (?:\w+ ){{0,2}}{_SCRIPT_WORD}\b|\b(?:active|activar|habilite|habilitar|permita) (?:\w+ ){{0,2}}{_SCRIPT_WORD}\b|\b{_SCRIPT_WORD} (?:está|es|est) (?:\w+ ){{0,2}}(?:desactivado|necesario|deshabilitado|désactivé|requis|bloqueado|bloqué)\b|\bwithout {_SCRIPT_WORD}\b(?: enabled)?"
    rf"|\b(?:abilita|abilitare|attiva|attivare|ative|ativar|habilite|schakel|zet|aktivera|aktiver|włącz|włączyć|включите|включить|etkinleştirin|zapněte) (?:\w+ ){{0,2}}{_SCRIPT_WORD}\b|\b{_SCRIPT_WORD} (?:è|é|está|is|är|er|jest) (?:\w+ ){{0,2}}(?:disabilitato|disattivato|richiesto|necessario|desativado|necessário|uitgeschakeld|vereist|inaktiverat|wyłączony)\b|{_SCRIPT_WORD} ?(?:を有効|が無効)|(?:启用|啟用|开启) ?{_SCRIPT_WORD}",
    re.I,
)
#: Openings that make a notice: an order or a statement to the reader, not a report on one.
_ADDRESS = re.compile(rf"^(?:please|bitte|veuillez|por favor|you need|you must|to (?:use|view|see|continue)|we(?: a|')re sorry|sorry|if nothing (?:appears|happens|loads)|this (?:page|site|app|application|content|view|website)|diese (?:seite|anwendung|website|app)|cette (?:page|application)|ce site|esta (?:página|aplicación)|este (?:sitio|contenido)|your browser|ihr browser|votre navigateur|su navegador|loading|laden|chargement|cargando|{_SCRIPT_WORD}\b|active|activez|enable|turn on|allow|aktivieren|pour |para |für |um |abilita|attiva|ative|schakel|zet|aktivera|aktiver|włącz|включите|per |voor |aby |чтобы |このサイト|このページ|请|請|lütfen|per favore|prosimy|пожалуйста|il tuo browser|o seu navegador|uw browser|questa (?:pagina|applicazione)|questo sito|esta (?:aplicação)|deze (?:pagina|site))", re.I)

#: What error pages say, each as a whole line or sentence.
_STATUS = r"(?:bad request|unauthorized|forbidden|not found|method not allowed|request time-?out|conflict|gone|too many requests|internal server error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
_ERROR = re.compile(
    rf"(?:http )?(?:status |error |fehler |erreur )?[45]\d\d\b[ :–—-]*{_STATUS}.*|http (?:status|error) [45]\d\d.*|{_STATUS}|(?:error|fehler|erreur) ?[45]\d\d\b.{{0,40}}|(?:error|fehler|erreur|fallo) (?:code |nr\.? ?|no\.? ?)?:? ?\d+(?:[: ].{{0,60}})?|(?:error )?code ?:? ?\d{{3,5}}|request id ?:? ?[0-9a-f-]{{6,}}|reference #[0-9a-f]+|\w+/\d+\.\d+(?:\.\d+)?|type: exception report|message: (?:null|none|undefined)|\[object object\]|undefined|null|nan"
    r"|traceback \(most recent call last\):?|\s*file \"[^\"]+\", line \d+.*|(?:[a-z_]+\.)*[a-z]*(?:error|exception): .{0,200}|(?:uncaught |fatal )(?:\w*error|exception)\b.*|\s*at [\w.$<>]+ ?\([^()]*:\d+(?::\d+)?\)|cannot (?:get|post) /.*"
    r"|(?:seite|datei) (?:wurde )?nicht gefunden|interner (?:serverfehler|fehler)|zugriff verweigert|die angeforderte (?:nachricht|seite|datei|ressource) .{0,60}(?:nicht|gelöscht).{0,40}|(?:oups ?!? ?)?cette page (?:est introuvable|n'existe (?:pas|plus))|page (?:introuvable|non trouvée)|erreur interne(?: du serveur)?|accès (?:refusé|interdit)|error interno del servidor|página no encontrada|(?:la )?página (?:que busca )?no (?:existe|se ha encontrado|encontrada)|acceso denegado|inténtelo de nuevo más tarde\b.{0,40}"
    r"|(?:(?:we'?re |we are |i'?m )?(?:so |very )?(?:sorry|oops|uh-?oh|whoops|hmm+)[!,.: ]*(?:but )?)?(?:the|this|that) (?:requested )?(?:page|file|resource|document|message|item|content|link|url|site) ?(?:that )?(?:you(?:'re| are| were|'ve| have)? (?:requested|looking for|trying to (?:reach|view|open)|asked for))? ?(?:could not be found|couldn't be found|cannot be found|can't be found|was not found|wasn't found|does not exist|doesn't exist|no longer exists|is not available|isn't available|is unavailable|is no longer available|has been (?:moved|removed|deleted)(?: or (?:moved|removed|deleted|renamed))?)(?: anymore| any more| right now| at the moment)?"
    r"|pagina (?:non trovata|niet gevonden)|la pagina (?:richiesta|che cerchi|cercata) non (?:esiste|è stata trovata|è disponibile)|(?:a )?página (?:que (?:procura|você procura) )?(?:não (?:foi )?encontrada|não existe)|acesso negado|accesso negato|toegang geweigerd|errore interno(?: del server)?|erro interno(?: do servidor)?|(?:de )?pagina (?:die u zoekt )?(?:bestaat niet|is niet gevonden|kan niet worden gevonden)|sidan (?:hittades inte|kunde inte hittas)|siden (?:ble ikke funnet|blev ikke fundet)|sivua ei löytynyt|nie znaleziono strony|strona nie (?:istnieje|została znaleziona)|stránka nenalezena|страница не найдена|доступ запрещ[её]н|внутренняя ошибка сервера|sayfa bulunamadı|ページが見つかりません(?:でした)?。?|(?:找不到|未找到)(?:该)?(?:网页|页面)|页面不存在|페이지를 찾을 수 없습니다"
    r"|(?:oops[!,. ]*)?(?:something|etwas) (?:went wrong|ist schiefgelaufen)|(?:oops[!,. ]*)?(?:page|file|resource|message|document) (?:was )?not found|access (?:is )?denied|permission denied|you (?:do not|don't) have (?:permission|access)\b.{0,60}|(?:your|the) session (?:has )?expired\b.{0,60}|please sign in again\b.{0,40}|ihre sitzung ist abgelaufen\b.{0,60}|votre session a expiré\b.{0,60}|su sesión ha (?:expirado|caducado)\b.{0,60}|this (?:message|page|item|content|file|link) is no longer (?:available|here)|(?:the )?(?:upstream|origin) (?:host|server) (?:did not|didn't) (?:answer|respond).{0,40}|(?:temporarily )?down for maintenance\b.{0,40}|(?:we are |we're )?(?:currently )?(?:under|undergoing) maintenance\b.{0,60}|wegen wartung\b.{0,60}|checking your (?:connection|browser) before you continue|rate (?:is )?limit(?:ed| exceeded)|too many requests\b.{0,60}|connection (?:timed out|refused|reset)\b.{0,40}|(?:we |the server )?(?:could not|couldn't|cannot|can't|unable to|failed to) (?:load|open|find|process|complete|display|show) (?:this|the|your|that)\b.{0,40}",
    re.I,
)
#: What may stand beside such a sentence in the same line.
_BESIDE = re.compile(r"(?:oups|oops|ups|uups|hoppla|sorry|désolé|entschuldigung|lo sentimos)[ ,!.]*|(?:please )?(?:try|check) again\b.{0,30}|bitte versuchen sie es\b.{0,30}|veuillez réessayer\b.{0,30}|back to start|home|reload(?: the page)?|contact support", re.I)
_ERROR_JSON = re.compile(r'^\{\s*"(?:error|errors|fault|exception)"\s*:\s*[\[{"]')
_HTML_PAGE = re.compile(r"<(?:html|head|title|h1|body|noscript)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: Stems, one of which every line with evidence holds; lines without any are left at once.
_STEMS = """has_been_ t_available not_available type_something type_anything type_here write_something write_here escribe_ teclee_ tapez_ saisi testo_qui pagina_ página_ sidan_ siden_ sivua_ strona_ nie_znaleziono stránka_ страниц доступ ошибка sayfa_ ページ 网页 页面 페이지 accesso_ acesso_ toegang_ errore_ erro_
{ [ < % $ # @ *| __ xx. tbd tba tbc todo script js err fehler fallo exception undefined null nan traceback status request conflict gone forbidden
unauthorized gateway unavailable timeout time-out denied verweigert refus interdit denegado expired abgelaufen expiré expirado caducado no_longer not_found gefunden
introuvable trouvée exist encontrad wrong schief maintenance wartung checking permission access upstream origin rate connection could cannot can't unable failed
refer code inténtelo again implemented allowed at_ lorem ipsu dolor amet elit labore veniam nostrud aliqu aute velit cillum pariatur sint culpa mollit
exercitation consequat consectetur incididunt tempor nisi nulla minim magna ullamco commodo eiusmod xx asdf qwer yxcv jkl foo bla dummy sample filler abc aaa bbb
zzz test text click cliquez haga heading column bullet item titel title details description placeholder überschrift spalte titre título subt sous-titre escriba
/0 /1 /2 /3 /4 /5 /6 /7 /8 /9 line_""".split()


@lru_cache(maxsize=1)
def _stems() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for stem in _STEMS:
        automaton.add_word(stem.replace("_", " ") if stem != "__" else stem, True)
    automaton.make_automaton()
    return automaton


def _triggered(line: str) -> bool:
    return next(_stems().iter(line.lower()), None) is not None


def _placeholder(line: str) -> bool:
    bare = _QUOTES.sub(" ", line)
    for m in _PLACEHOLDERS.finditer(bare):
        if not (_STRICT_CASE.match(m.group()) and m.group() != m.group().upper()):
            return True
    if _ANGLE.search(bare):
        return True
    found = [m.start() for m in _BRACKET.finditer(bare)]
    if found:
        opening = sum(not bare[:at].strip() or bare[:at].rstrip()[-1] in ",.;" for at in found)
        if not (len(found) >= 2 and opening == len(found)) and not re.match(r"\s*\[[^\]]+\]\(", bare):
            return True
    return False


def _filler(line: str) -> bool:
    words = re.findall(r"[^\W\d_]+", line.casefold())
    if len(words) >= 5 and sum(w in LATIN for w in words) >= 0.8 * len(words) and sum(w in LATIN_SURE for w in words) >= 0.4 * len(words):
        return True
    if len(words) >= 3 and words[:2] == ["lorem", "ipsum"] and all(w in LATIN for w in words):
        return True
    return len(words) >= 4 and sum(w in KEYS or len(set(w)) == 1 for w in words) >= 0.9 * len(words)


def evidence(line: str, raw: str) -> str | None:
    """What the line shows: 'placeholder', 'filler', 'error', 'script', 'slide' or None. ``raw`` still has its tags.

    'slide' is a bare label of an unfilled form or slide, which counts beside another one only.
    """
    if not line or not _triggered(line):
        return None
    if _ERROR_JSON.match(line):
        return "error"
    if _CODE.search(line) and not _ERROR.fullmatch(line.rstrip(".!")):
        return None
    if _filler(line):
        return "filler"
    sentences = [t.strip("() ") for t in _SENTENCE.split(line)]
    bare = [t.rstrip(".! ") for t in sentences if t]
    if all(_SLIDE.fullmatch(t) for t in bare):
        return "filler" if len(bare) > 1 or " " in line and not line[-1].isdigit() else "slide"
    page = bool(_HTML_PAGE.search(raw))
    if any(errors := [bool(_ERROR.fullmatch(t)) for t in bare]) and (page or all(e or _BESIDE.fullmatch(t) for e, t in zip(errors, bare, strict=True))):
        return "error"
    low = line.lower()
    if ("script" in low or "js" in low) and any(_SCRIPT.search(s) and (page or _ADDRESS.match(s)) for s in sentences):
        return "script"
    return "placeholder" if _MARKS.search(line) and _placeholder(line) else None


def _keep_tags(lead: re.Match) -> str:
    return "".join(re.findall(r"</?(?:html|head|body|noscript|h\d)\b[^>]*>", lead.group(), re.I))


def lines(text: str) -> Iterator[tuple[str, str, int]]:
    """(line, raw line, number of its passage), code left out, entities decoded, marks at the front and tags off."""
    text, passage = _INLINE.sub(" ", _FENCE.sub("\n\n", text)), 0
    for raw in text.splitlines():
        if not raw or raw.isspace():
            passage += 1
            continue
        flat = unicodedata.normalize("NFKC", raw) if not raw.isascii() else raw
        lead = _LEAD.match(flat)
        # Marks and blocks make a passage of their own.
        apart = bool(lead and lead.group().strip()) or "<" in flat and bool(_BLOCKS.search(flat))
        flat = _LEAD.sub("", flat) if "<" not in flat else _BLOCKS.sub("\n", _LEAD.sub(_keep_tags, flat))
        for part in flat.split("\n"):
            line = " ".join(html.unescape(_TAGS.sub(" ", part) if "<" in part else part).split())
            passage += apart or not line
            if line:
                yield line, raw, passage
        passage += apart


_DIGITS = re.compile(r"\d+")


def _key(line: str) -> int:
    return xxhash.xxh64_intdigest(line.casefold()) - 2**63


def _judged(text: str) -> dict[int, tuple[list[str], list[str]]]:
    """For each line's key the kinds of evidence of all its occurrences: those that always count, and those that count unless the line recurs."""
    rows = [(line, evidence(line, raw), passage) for line, raw, passage in lines(text)]
    mixed = {passage for _, kind, passage in rows if kind is None}
    seen: dict[int, tuple[list[str], list[str]]] = {}
    for line, kind, passage in rows:
        key = _key(line if kind is None else _DIGITS.sub("0", line))
        sure, loose = seen.setdefault(key, ([], []))
        if kind is not None:
            (loose if passage in mixed and kind != "placeholder" else sure).append(kind)
    return seen


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, keys, sures, looses, doubts = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            seen = _judged(text)
            doubt = any(loose for _, loose in seen.values())
            at += [i] * len(seen)
            keys += seen
            sures += [sure or None for sure, _ in seen.values()]
            looses += [loose or None for _, loose in seen.values()]
            doubts += [doubt] * len(seen)
        rows = batch.select(["doc_id", "host", "body"]).take(pa.array(at, pa.int64()))
        kinds = [pa.array(v, pa.list_(pa.string())) for v in (sures, looses)]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.int64()), *kinds, pa.array(doubts, pa.bool_())], names=["doc_id", "host", "body", "line", "sure", "loose", "doubt"])


def residual_evidence(docs: DataFrame, furniture: float = FURNITURE) -> DataFrame:
    """doc_id, kind: the kinds of evidence in each document's residual lines."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("body"), "text")
    # Kept in the shared folder: the texts are read and judged once, for the counts and for the evidence.
    found = cut(rows.filter("text is not null").mapInArrow(_line_batches, "doc_id long, host string, body long, line long, sure array<string>, loose array<string>, doubt boolean"))
    sizes = rows.groupBy("host").agg(F.count_distinct("body").alias("texts"))
    counts = found.groupBy("host", "line").agg(F.count_distinct("body").alias("n")).filter("n > 1")
    boilerplate = counts.join(sizes, "host").filter(F.col("n") >= F.col("texts") * furniture).select("host", "line", F.lit(True).alias("recurs"))
    doubtful = found.filter("doubt").join(boilerplate, ["host", "line"], "left")
    # A text's evidence beside nothing but boilerplate is its whole residual text.
    whole = doubtful.groupBy("doc_id", "body").agg((F.count_if(F.expr("recurs is null and sure is null and loose is null")) == 0).alias("whole"))
    kept = doubtful.filter("loose is not null").join(whole, ["doc_id", "body"]).filter("whole or recurs is null")
    hits = found.filter("sure is not null").select("doc_id", F.explode("sure").alias("kind")).unionByName(kept.select("doc_id", F.explode("loose").alias("kind")))
    hits = hits.groupBy("doc_id").agg(F.count_if(F.col("kind") == "slide").alias("slides"), F.collect_set("kind").alias("kinds"))
    # A repeated doc_id counts its rows together; a lone slide label is no evidence.
    kinds = F.explode(F.when(F.col("slides") >= 2, F.col("kinds")).otherwise(F.array_remove("kinds", "slide")))
    return hits.select("doc_id", kinds.alias("kind")).withColumn("kind", F.when(F.col("kind") == "slide", "filler").otherwise(F.col("kind"))).distinct()


def excluded(docs: DataFrame) -> DataFrame:
    return residual_evidence(docs).select("doc_id").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """The documents without evidence, all columns kept."""
    return docs.join(excluded(docs), "doc_id", "left_anti")
