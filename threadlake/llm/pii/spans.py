"""Candidate segments of a text, each with the features of the whole span.

Every generator proposes more than is true; the model decides. A text without candidates has the empty segmentation.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from threadlake.llm.pii.view import CLOSE, OPEN

TYPES = ("email", "phone", "id_number", "address", "name")


class Segment(NamedTuple):
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


# Emails

_AT = re.compile(r" ?@ ?| ?[\[({<] ?(?:at|@|ät) ?[\])}>] ?|(?<=[\w\])]) (?:at|AT|ät|arroba|chez) (?=[a-z])", re.I)
_DOT = r"(?:\.|[\[({]\.[\])}]| ?[\[({] ?(?:dot|punkt|point|punto) ?[\])}] ?| (?:dot|punkt|point|punto) )"
#: The local part is read backwards from the sign, so that it is matched in one place only.
_DOT_BACK = r"(?:\.|[\])}]\.[\[({]| ?[\])}] ?(?:tod|tknup|tniop|otnup) ?[\[({] ?| (?:tod|tknup|tniop|otnup) )"
_LOCAL_BACK = re.compile(rf"[\w'+%&~-]+(?:{_DOT_BACK}[\w'+%&~-]+)*(?<=[\w])", re.I)
_DOMAIN = re.compile(rf"[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9][a-z0-9-]*)*{_DOT}([a-z]{{2,24}})(?![\w-])", re.I)
#: Last labels of domain names that are in common or reserved use.
_TLDS = frozenset("com org net edu gov mil int info biz name io co ai app dev eu de at ch fr es it pt nl be lu uk ie us ca mx br ar cl pl cz sk hu ro bg gr dk se no fi is ee lv lt ru ua tr il in cn jp kr au nz za example test invalid local localhost".split())


def _local(text: str, end: int) -> re.Match | None:
    """The local part that ends at a place, read backwards; the stretch looked at grows until it holds all of it."""
    size = 64
    while True:
        found = _LOCAL_BACK.match(text[max(0, end - size) : end][::-1])
        if size >= end or not found or found.end() + 12 < size:
            return found
        size *= 4


def emails(text: str) -> list[Segment]:
    found = []
    for m in _AT.finditer(text):
        domain = _DOMAIN.match(text, m.end())
        local = domain and _local(text, m.start())
        if not local:
            continue
        sign, host = m.group(), domain.group()
        how = "plain" if sign == "@" else "spaced" if "@" in sign and sign.strip() == "@" else "bracket" if sign.strip()[:1] in "[({<" else "word"
        dots = "plain" if re.fullmatch(r"[\w.-]+", host) else "spelled"
        known = domain.group(1).lower() in _TLDS
        if how == "word" and dots == "plain":
            continue
        features = [f"email:{how}", f"email:dots={dots}", f"email:{'known' if known else 'other'}_tld"]
        if re.search(r"[0-9]", host.replace("dot", "")) and not re.search(r"[g-z]", re.split(r"\W", host.lower())[0]):
            features.append("email:hex_host")
        start = m.start() - local.end()
        # With a spelled-out address the local part may have swallowed a word before it: shorter ones compete.
        found.append(Segment(start, domain.end(), "email", tuple(features)))
        words = [w.start() for w in re.finditer(r"(?<=\s)\S", text[start : m.start()])]
        found += [Segment(start + w, domain.end(), "email", (*features, "email:shorter")) for w in words if " dot " not in text[start : start + w + 5]]
    return found


# Numbers

_EXT = r"(?:,? ?(?:ext|extension|x|durchwahl|dw|poste|apt)\.? ?\d{1,5})?"
_BEFORE = r"(?<![\w@#])(?<![\w)][-./:+])(?<!\d )"
_AFTER = r"(?![\w@])(?![.,:/-]\w)(?! \d)"
_PHONES = {
    "plus": r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{1,5}){1,6}",
    "zeros": r"00[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ ./-]\d{2,8}){1,5}",
    "nanp": r"(?:1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}",
    "trunk": r"\(0\) ?\d{2,5}(?:[ ./-]?\d{2,8}){1,4}",
    "area": r"\(?0\d{1,4}\)?[/-] ?\d{3,9}(?:[ -]?\d{1,4})?",
    "pairs": r"0\d(?:[ .-]\d\d){4}",
    "national": r"0[1-9]\d{1,3} \d{3,4} ?\d{3,5}",
    "local": r"\d{3}[.-]\d{4}",
    "tel": r"(?<=tel:)\+?[\d().-]{6,20}\d",
}
_PHONE = re.compile("|".join(f"(?P<{k}>{_BEFORE if k != 'tel' else ''}{v}{_EXT}{_AFTER})" for k, v in _PHONES.items()), re.I)
_CALL = re.compile(r"(?:\b(?:tel|phone|mobile|mob|cell|fax|call|dial(?:-in)?|text|ring|reach|number|handy|telefon|rufnummer|erreichbar|anrufen|nummer|numéro|téléphone|appel\w*|joindre|teléfono|móvil|llám\w*|número)\b|☎)[^\n]{0,24}\Z", re.I)
_THING = re.compile(r"\b(?:seq|sequence|key|commit|hash|ticket|build|version|tracking|parcel|cost cent(?:re|er)|message|msg|order|invoice|bridge|room|meeting id|conference id|thread|id|ref|reference|case|inc|pin|batch|serial|sku|port|row|page|step|spare part|part)[\s:#.-]*(?:id|no\.?|number)?[\s:#.-]*\Z", re.I)

_IDS = {
    "ssn": r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}|\d{3}\.\d\d\.\d{4}",
    "nine": r"\d{9}",
    "ni": r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]",
    "dni": r"\d\d\.?\d{3}\.?\d{3} ?-? ?[A-Z]|[XYZ]-?\d{7}-?[A-Z]",
    "eleven": r"\d\d ?\d{3} ?\d{3} ?\d{3}",
    "nir": r"[1-4] ?\d\d ?[01]\d ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d\d)?",
    "card": r"[A-Z]\d{2,3}[A-Z]{1,2}\d{4,5}|[A-Z]\d[A-Z]\d{6}|[A-Z]{1,2}\d{6,8}|[A-Z0-9]{1,2}[0-9A-Z]\d{3}[0-9A-Z]{3,5}",
    "licence": r"[A-Z]\d{3,4}[- ]\d{4,5}[- ]\d{4,5}|[A-Z]{5}\d{6}[A-Z0-9]{5}|[A-Z]\d{7,12}",
}
_ID = {k: re.compile(f"(?<![\\w@#+])(?<![\\w][-./:])(?:{v})(?![\\w@])(?![-./:]\\w)") for k, v in _IDS.items()}
_LABEL = re.compile(
    r"(?:social security(?: (?:number|no\.?|nr\.?))?|\bssn|\bitin|\bni (?:number|no\.?)|national insurance(?: number)?|passport(?: (?:number|no\.?|nr\.?))?|reisepass(?:nummer)?|\bpass(?:nummer|-nr\.?)|personalausweis(?:nummer)?|\bausweis(?:nummer|-nr\.?)?|\bid card(?: (?:number|no\.?))?|identity card|national id|driv(?:er|ing)(?:'?s)? licen[cs]e(?: (?:number|no\.?))?|führerschein(?:nummer)?|permis de conduire|carte d'identité|passeport|n° de sécurité sociale|sécurité sociale|numéro de sécu\w*|\bdni|\bnie|\bnif|pasaporte|carn[eé]t de conducir|seguridad social|steuer-?(?:id|nummer|identifikationsnummer)|sozialversicherungsnummer|tax (?:id|number|file number)|taxpayer id|numéro fiscal)[ :.#°-]*(?:is|ist|est|es|lautet)?[ :]*\Z",
    re.I,
)
_PRIVATE = re.compile(r"(?:do not share|don't share|nicht weitergeben|ne pas (?:partager|diffuser)|no compartir|on file|at the gate|à la réception|en recepción|am empfang|confidential|vertraulich)", re.I)
_ASKED = re.compile(r"(?:asked for|visitor pass|still has|formular steht|j'ai donné|les di|gave them|my number is|for the (?:badge|form|visa)|ausweis|in the form)[^\n]{0,20}\Z", re.I)


def numbers(text: str) -> list[Segment]:
    found = []
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 7 <= digits <= 20:
            ext = ["phone:ext"] if re.search("[a-z]", m.group(), re.I) else []
            found.append(Segment(m.start(), m.end(), "phone", (f"phone:{m.lastgroup}", *ext, *_around(text, m.start(), m.end(), "phone"))))
    for k, pattern in _ID.items():
        for m in pattern.finditer(text):
            if sum(c.isdigit() for c in m.group()) >= 5:
                found.append(Segment(m.start(), m.end(), "id_number", (f"id:{k}", *_around(text, m.start(), m.end(), "id"))))
    return found


def _around(text: str, start: int, end: int, kind: str) -> list[str]:
    left, right = text[max(0, start - 44) : start], text[end : end + 28]
    features = []
    if _LABEL.search(left):
        features.append(f"{kind}:label")
    elif _THING.search(left):
        features.append(f"{kind}:thing")
    if _CALL.search(left):
        features.append(f"{kind}:call")
    if _PRIVATE.search(right) or _ASKED.search(left):
        features.append(f"{kind}:private")
    return features


# Addresses

_CAP = r"[A-ZÀ-ÖØ-ÞŁŽŠČŚŻĐ][\w'’-]*"
_CITY = rf"{_CAP}(?: (?:am|an der|bei|sur|de|del|la|le|les|upon|{_CAP}))?"
_EN = "street|st|road|rd|avenue|ave|lane|ln|drive|way|court|place|square|sq|boulevard|blvd|terrace|crescent|close|row|walk|hill|grove|gardens|highway|hwy|parkway|pkwy|mews|quay|rise|vale|gate|broadway|walkway|green|end"
_TAILC = rf"(?:(?i:,? (?:apt|apartment|flat|unit|suite|ste)\.? ?\w{{1,5}}\b))?(?:(?:,\s?|\s?\n\s?| in | - | – )(?:\d{{4,5}} )?{_CITY}(?:,? \d{{4,5}}(?!\d))?| \d{{4,5}} {_CITY})?"
_NUMBER = re.compile(r"(?<![\w.,:#])(?<!\w[-/])\d{1,5}|(?<=\.)\d{1,4}(?!\w*\d)")
_TAIL = re.compile(_TAILC)
_BLANK = re.compile(r"\s")
#: A street behind its number, or before it, by language; each with the pattern at the number's side.
_EN_RIGHT = re.compile(rf"\d{{1,5}}(?:-\d{{1,5}})?[a-zA-Z]?,? (?:{_CAP}\.? ){{1,3}}(?i:{_EN})\b\.?")
_EN_LEFT = re.compile(r"(?i:flat|apt|unit|suite|apartment) ?\w{1,4},? \Z")
_FR_RIGHT = re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?i:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|cours|route|square)(?: (?:du|de la|de l'|des|de|d'|la|le))? ?(?:{_CAP} ?){{1,3}}(?<! )")
_DE_STEMS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "chaussee", "markt", "graben", "stieg")
_DE_STEM = "|".join(map(re.escape, _DE_STEMS))
_DE_LEFT = re.compile(rf"(?:(?:{_CAP}[ -])?[A-ZÄÖÜ][\wäöüß-]*(?i:{_DE_STEM})|(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der|Vor dem) )?(?:{_CAP}[ -]){{1,3}}(?i:{_DE_STEM})) ?\Z")
#: The same behind a word that only opens a sentence is no street.
_DE_OPENING = re.compile(r"(?:Der|Die|Das|Den|Dem|Ein|Eine|Einen|Einem|Kein|Keine|Keinen|Mein|Dein|Ihr|Unser|Dieser|Diese|Jeder|Jede|Welcher|Ob|Wenn|Seite|Auf|Bis|Von|Nach)[ -]", re.I)
_DE_RIGHT = re.compile(r"\d{1,4} ?[a-z]?\b(?: ?[-/] ?\d{1,4}\b)?")
_ES_LEFT = re.compile(rf"(?i:\b(?:calle|avenida|avda\.?|av\.|plaza|pza\.?|paseo|carretera|camino|ronda)|\bc/)(?: (?:de la|de los|del|de))? ?(?:{_CAP},? ){{1,3}}(?:n[º°.] ?)?\Z")
_ES_RIGHT = re.compile(r"\d{1,4}\b(?:,? ?\d{1,2}[ºª°] ?\w{1,5}\b)?")
_BOX_LEFT = re.compile(r"(?i:\bp\.? ?o\.? ?box|\bpostfach|\bpost office box|\bboîte postale|\bb\.?p\.?|\bapartado(?: de correos)?|\bapdo\.?) ?\Z")
_BOX_ENDS = ("box", "postfach", "postale", "bp", "b.p.", "apartado", "correos", "apdo", "apdo.")
_ES_STEMS = ("calle", "c/", "aven", "avda", "av.", "plaza", "pza", "paseo", "carretera", "camino", "ronda")


def addresses(text: str) -> list[Segment]:
    """Each number that may be a house or box number is looked at with the words on either side."""
    found = []
    blanks: list[int] = []

    def _words_before(p: int) -> int:
        """Where the eight words before a place begin, however long they are."""
        if not blanks:
            blanks.extend(b.start() for b in _BLANK.finditer(text))
        at = bisect_left(blanks, p) - 9
        return blanks[at] + 1 if at >= 0 else 0

    for m in _NUMBER.finditer(text):
        p = m.start()
        left = text[_words_before(p) if text[p - 1 : p].isspace() or text[p - 1 : p] in ".º°/" else max(0, p - 60) : p]
        low = left.lower()
        bare = low.rstrip()
        if hit := _EN_RIGHT.match(text, p):
            flat = _EN_LEFT.search(left)
            found.append(_address(text, "en", p - (len(flat.group()) if flat else 0), hit.end()))
        if hit := _FR_RIGHT.match(text, p):
            found.append(_address(text, "fr", p, hit.end()))
        if bare.endswith(_DE_STEMS) and (hit := _DE_LEFT.search(left)) and (right := _DE_RIGHT.match(text, p)):
            opening = _DE_OPENING.match(hit.group())
            found.append(_address(text, "de", p - len(left) + hit.start(), right.end(), ("address:opening",) if opening else ()))
        if any(stem in low for stem in _ES_STEMS) and (hit := _ES_LEFT.search(left)) and (right := _ES_RIGHT.match(text, p)):
            found.append(_address(text, "es", p - len(left) + hit.start(), right.end()))
        if bare.endswith(_BOX_ENDS) and (hit := _BOX_LEFT.search(left)):
            found.append(_address(text, "box", p - len(left) + hit.start(), m.end()))
    return found


def _address(text: str, kind: str, start: int, end: int, more: tuple[str, ...] = ()) -> Segment:
    tail = _TAIL.match(text, end)
    end = tail.end() if tail else end
    whole = text[start:end]
    features = [f"address:{kind}", *more]
    if re.search(r"\d{4,5}", whole):
        features.append("address:postcode")
    if re.search(r",|\n| in | - ", whole):
        features.append("address:city")
    return Segment(start, end, "address", tuple(features))


# Names

_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĖĘĚĜĞĠĢĤĦĪĮİĴĶĹĻĽŁŃŅŇŌŐŒŔŘŚŜŞŠŢŤŪŮŰŲŴŶŸŹŻŽ"
_WORD = re.compile(rf"[{_UPPER}][^\W\d_]+(?:['’-][^\W\d_]+)*|(?:[dDlOM]['’]|Mc|Mac)[{_UPPER}][^\W\d_]+(?:-[^\W\d_]+)*")
_PARTICLE = r"(?:(?:van|von|de|del|della|der|den|dem|di|da|du|dos|das|la|le|los|zu|zum|zur|ter|ten|af|av|bin|ibn|al|el|y|van't) ){1,3}"
_LINK = re.compile(rf" (?:[{_UPPER}]\.? )?(?:{_PARTICLE})?\Z")
_LINKED = re.compile(rf"(?: (?:[{_UPPER}]\. ){{0,2}}(?:{_PARTICLE})?|, )")
_TITLE = re.compile(r"(?:\b(?:Mrs?|Ms|Mx|Miss|Dr|Prof|Professor|Doctor|Sir|Lady|Herrn?|Frau|Fräulein|Mme|Mlle|Monsieur|Madame|Mademoiselle|Maître|Sr|Sra|Srta|Señora?|Señorita|Don|Doña)\.?|(?<![\w.])M\.) (?:(?:Dr|Prof)\.? )?(?:[A-Z]\. )?" + f"(?:{_PARTICLE})?\\Z")
_INITIAL = re.compile(rf"(?<![\w.'’-])[{_UPPER}]\. ?(?:[{_UPPER}]\. ?)?(?:{_PARTICLE})?\Z")
_CAP_BEFORE = re.compile(rf"[{_UPPER}][^\W\d_]+ [{_UPPER}]\. ?\Z")
_TITLES = frozenset("Mr Mrs Ms Mx Miss Dr Prof Professor Doctor Sir Lady Herr Herrn Frau Fräulein Mme Mlle Monsieur Madame Mademoiselle Maître M Sr Sra Srta Señor Señora Señorita Don Doña".split())
_PARTICLES = frozenset("van von de del della der den dem di da du dos das la le los zu zum zur ter ten af av bin ibn al el y".split())
#: Words with a capital that begin sentences or name days and months, in four languages.
_COMMON = frozenset(
    "the a an this that these those we you he she it they i my our your his her its there here what when where who why how which if then after before while as at on in for from to of by with and or but not no nobody nothing only can could would should may might must do does did is are was were will please thanks thank hi hello dear step build page room desk project bridge team office meeting monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "der die das ein eine einen dem den des wir ihr sie er es ich mein unser kannst können wenn weil ob und oder aber nicht kein danke bitte hallo liebe lieber seite bei für im am zum zur vom nach vor auf über unter mit ohne wer wie wo was wann warum montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember "
    "le la les un une des du de nous vous il elle ils elles on je mon notre votre est sont merci bonjour après avant avec sans pour dans sur qui que quoi où quand comment pourquoi d'accord lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "el los las una unos nosotros vosotros ella ellos yo mi nuestro es son gracias hola después antes con sin para en sobre quién qué dónde cuándo cómo por lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lo les".split()
)
_PLACES = re.compile(r"(?:ford|heim|haven|stedt|wick|ville|bridge|burg|moor|field|feld|lago|mere|court|egg|clara|port|stadt|dorf|hausen|ingen|ton|bury|mouth|shire|street|straße|weg|platz|lane|avenue)$", re.I)


def _plain(word: str) -> str:
    return word.capitalize() if word.isupper() and len(word) > 2 else word


#: Words with a capital that stand for things and places, before or after a name's words.
_THINGS = frozenset(
    "street road avenue lane drive way square place park garden gardens hill hills falls creek river lake bay beach mountain mount valley ridge forest wood woods island bridge tower house hall castle court gate station airport harbour harbor port city town village county district building room floor desk office center centre campus school college university institute academy library museum hospital clinic church cathedral theatre theater hotel bank company group team project release version phase sprint board committee council department ministry agency foundation society association union party league club award prize cup day week month year time zeit hat street straße platz weg allee gasse brücke turm haus schule universität institut klinik kirche verein bank gruppe projekt ausgabe nacht stunde woche nachmittag vormittag mittag monatsende zug minuten rue avenue boulevard place parc jardin pont tour école université institut hôpital église musée projet version calle plaza avenida parque jardín puente torre escuela universidad instituto hospital iglesia museo proyecto versión mews quay close crescent terrace teams chrome studio server states kingdom republic cloud drive docs sheets calendar code services systems software windows reader engine hub desktop app web api media news network online store solutions technologies labs games edition manager explorer player suite pro mail".split()
)
_PLACE_FIRST = frozenset("san santa santo são saint sankt st ste new old north south east west upper lower great little mount lake fort port cape los las el la le les nueva nuevo neu neue alt alte groß große bad villa costa puerto río rio monte".split())
#: Words that stand before or after people, rather than things.
_CUES_LEFT = frozenset("ask asked asking met meet meeting call called tell told with by from to for thank thanks cc invite invited contact email see saw know and or via per bitte an von mit bei durch für frag fragt traf und de par avec pour chez à et con por para a y según".split())
_CUES_RIGHT = frozenset("is was has had will said says takes took wrote writes joined joins leaves left fixed asked asks wants knows lives works called and or who whom should can could macht hat ist war wird sagt schreibt übernimmt und est a était dit prend et es ha era dice lleva y".split())
_ARTICLE = re.compile(r"(?:^|[^\w])(?:the|a|an|der|die|das|den|dem|des|ein|eine|einen|einem|le|la|les|un|une|el|los|las|una)\s+\Z", re.I)
_LEFT_WORD = re.compile(r"([^\W\d_]+)[ ]+\Z")
_RIGHT_WORD = re.compile(r" ([^\W\d_]+)")
_RIGHT_CAP = re.compile(rf" ([{_UPPER}][^\W\d_]+)")
#: The longest link between two words of a name is shorter than this.
_LINK_SIZE = 40
_MAX_WORDS = 4


def _kind(word: str, lexicon: Lexicon) -> str:
    """What a word with a capital looks like: a given name, the ending of a family name, a common word, a thing or place, a word in capitals, or unknown."""
    low = word.lower()
    if lexicon.is_given(word):
        return "G"
    if lexicon.family(word):
        return "F"
    if low in _COMMON or word in _TITLES:
        return "C"
    if low in _THINGS or low in _PLACE_FIRST:
        return "P"
    if _PLACES.search(word):
        return "L"
    return "X" if word.isupper() else "U"


#: Words of a language that writes all its nouns with capitals.
_NOUNS_BIG = re.compile(r"\b(?:der|die|das|und|ist|nicht|mit|ein|eine|einen|für|auf|von|zu|im|am|wird|sein|seine|nie|den|dem|bei|wir|ich|sich|oder)\b", re.I)
_SIGNED = re.compile(r"\b(?:signed|name|by|from|contact|owner|host|author|presenter|attendee|caller|regards|wishes|grüße|gruß|cordialement|saludos|dear|liebe|lieber|cher|chère|querida|querido)[:,]?\s+\Z", re.I)


def _context(text: str, start: int, end: int) -> list[str] | None:
    """Features of what stands around a span of unknown words; None where nothing tells a person from a thing."""
    features = []
    left, right = text[max(0, start - 24) : start], text[end : end + 24]
    if (m := _LEFT_WORD.search(left)) and m.group(1).lower() in _CUES_LEFT:
        features.append("name:cue_left")
    if (m := _RIGHT_WORD.match(right)) and m.group(1).lower() in _CUES_RIGHT:
        features.append("name:cue_right")
    if left.rstrip()[-1:].isdigit():
        features.append("name:number_before")
    if _ARTICLE.search(left):
        features.append("name:article")
    if m := _RIGHT_CAP.match(right):
        features.append("name:thing_next" if m.group(1).lower() in _THINGS else "name:capital_next")
    elif re.match(r" [^\W\d_]+ [a-z]+|[ -]?\d", right) and "name:cue_right" not in features:
        features.append("name:plain_next")
    bare = left.rstrip(" #*>•–-[")
    if not bare or bare[-1] in "\n\r(:.!?":
        features.append("name:opens")
    if not right.strip() or right[0] in "\n).,;:!?" :
        features.append("name:closes")
    if _SIGNED.search(left):
        features.append("name:signed")
    if not text[:start].strip() and not text[end:].strip(" \n.,!"):
        features.append("name:all")
    told = {"name:cue_left", "name:cue_right", "name:signed", "name:all"} & set(features)
    shouted = text[start:end].isupper() or re.match(r"\s?v?\d|\]", right)
    return features if told and not shouted or "name:opens" not in features and not shouted and not _NOUNS_BIG.search(text[max(0, start - 80) : end + 80]) else None


def names(text: str, lexicon: Lexicon) -> list[Segment]:
    """Spans of up to four words with a capital, with the title, initials and particles that belong to them.

    Every span of linked words is a candidate where one of its words is known, a title or mention mark stands before it,
    or none of its words is a common one or names a thing; the model weighs all spans against each other.
    """
    tokens = list(_WORD.finditer(text))
    if not tokens:
        return []
    found = []
    kinds = [_kind(t.group(), lexicon) for t in tokens]
    for i, t in enumerate(tokens):
        word, left = t.group(), text[max(0, t.start() - 64) : t.start()]
        family = lexicon.family(word)
        before = left[-12:].split(" ")[-2:-1] if left.endswith(" ") else []
        marked = bool(before) and (before[0][-1:] == "." or before[0].rstrip(".") in _TITLES or before[0] in _PARTICLES)
        title, initial = (_TITLE.search(left), _INITIAL.search(left)) if marked else (None, None)
        open_ = text[t.start() - 1 : t.start()] == OPEN
        if title and kinds[i] != "C":
            found.append(Segment(t.start() - len(title.group()), t.end(), "name", ("name:title", *family)))
        elif initial and kinds[i] != "C" and (family or kinds[i] != "G" and not _CAP_BEFORE.search(left)) and (not i or tokens[i - 1].end() < t.start() - len(initial.group()) - 1 or kinds[i - 1] != "G"):
            found.append(Segment(t.start() - len(initial.group()), t.end(), "name", ("name:initial", *family)))
        comma, last = False, t
        for j in range(i + 1, min(i + _MAX_WORDS, len(tokens))):
            nxt = tokens[j]
            gap = text[last.end() : nxt.start()]
            if len(gap) > _LINK_SIZE or not _LINKED.fullmatch(gap) or comma:
                break
            comma = gap == ", "
            if comma and j > i + 1:
                break
            last = nxt
            shape = "".join(kinds[i : j + 1])
            if not (set(shape) & {"G", "F"} or open_ or title and "C" not in shape or not set(shape) & {"C", "P", "L"}):
                continue
            second = nxt.group()
            given, family_word, family_kind = (second, word, kinds[i]) if comma else (word, second, kinds[j])
            known_family = lexicon.family(family_word)
            known = lexicon.is_given(given) or bool(known_family)
            if not known and not open_ and not title and set(shape) & {"C", "P", "L"}:
                continue
            features = ["name:comma" if comma else "name:pair", *known_family]
            features.append("name:given" if lexicon.is_given(given) else "name:other_given")
            if j > i + 1:
                features += ["name:longer", f"name:inner={kinds[i + 1]}"]
                if text[last.end() : last.end() + 1] == CLOSE and open_:
                    features.append("name:whole_mention")
            if not known:
                around = _context(text, t.start(), nxt.end())
                if around is None and not title and not open_ and not comma:
                    continue
                features += [f"name:shape={shape[:2]}", *(around or [])]
                if title:
                    features.append("name:titled")
            if comma and not known and not (kinds[i] == "X" and kinds[j] == "U"):
                continue  # a list of words, not a name turned round
            if family_kind == "G":
                features.append("name:both_given")
            if not comma and kinds[i] == "C":
                features.append("name:common_first")
            if family_kind == "C" or family_word.lower() in _COMMON:
                features.append("name:common_last")
            if family_kind in "PL" and not known_family:
                features.append("name:place" if family_kind == "L" else "name:thing")
            if kinds[i] == "P" and not comma:
                features.append("name:place_first")
            if known and (m := _RIGHT_CAP.match(text, nxt.end())) and m.group(1).lower() in _THINGS and not known_family:
                features.append("name:thing_after")
            if open_ and text[nxt.end() : nxt.end() + 1] == CLOSE:
                features.append("name:mention")
            if text[nxt.end() : nxt.end() + 1] in "@" or re.match(r"[+._-]?\w*@", text[nxt.end() : nxt.end() + 20]) and text[nxt.end() : nxt.end() + 1].strip():
                features.append("name:email_part")
            start = t.start() - (len(title.group()) if title else 0)
            found.append(Segment(start, nxt.end(), "name", tuple(features)))
    return found


class Lexicon:
    """Given names and endings of family names, learned from labelled people."""

    def __init__(self, given: frozenset[str], endings: frozenset[str]):
        self.given, self.endings = given, endings

    def is_given(self, word: str) -> bool:
        return _plain(word) in self.given

    def family(self, word: str) -> tuple[str, ...]:
        word = word.lower()
        return ("name:ending",) if len(word) > 5 and (word[-5:] in self.endings or word[-4:] in self.endings) else ()


_QUICK_AT = re.compile(r"@|[\[({<] ?[aäAÄ][tT] ?[\])}>]| (?:at|AT|ät|arroba|chez) ")
_DIGIT = re.compile(r"\d")
#: What every phone and identity number holds.
_LONG_NUMBER = re.compile(r"\d[\d ()./-]{2,}\d|\d[A-Z]\d")


def candidates(text: str, lexicon: Lexicon, kinds: frozenset[str]) -> list[Segment]:
    found: list[Segment] = []
    if "email" in kinds and _QUICK_AT.search(text):
        found += emails(text)
    if _DIGIT.search(text):
        if _LONG_NUMBER.search(text):
            found += numbers(text)
        if "address" in kinds:
            found += addresses(text)
    if "name" in kinds:
        found += names(text, lexicon)
    return found
