"""What personal information looks like: labels for a training sample, and checks of what the model found.

The labels are made by simple functions over a sample of texts (shapes of numbers
and addresses with the words beside them, a roster of names, words that introduce
a name). They need not find everything: the model learns from them and is asked
for all texts.
"""

from __future__ import annotations

import re
import unicodedata

TYPES = ("email", "phone", "id_number", "street_address", "person_name")

_AT = r"(?:@|＠|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{at\}\s?)"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?)"
_WORDS_AT = r"[\w.+-]+\sat\s[\w-]+(?:(?:\sdot\s|\.)[\w-]+)*\sdot\s[A-Za-z][\w-]*(?:\sdot\s[A-Za-z][\w-]*)*"
EMAIL = re.compile(rf"[\w.+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z][\w-]*|{_WORDS_AT}", re.I)
#: A number of seven to fifteen digits, perhaps with letters around it.
NUMBER = re.compile(r"(?<![\w.:/‑-])(?<!\d[ ,])(?:[A-Z]{1,2}[ -]?)?(?:\([+\d]|\+|\d)[\d  ().\-/‑–]{4,24}\d(?:[ -]?[A-Z](?![\w]))?|(?<![\w.:/‑-])\+?\(?\d{7,15}(?![\w])")
#: Two letters, six digits and a letter, in any case: too few digits for a number of the pattern above.
LETTERED_ID = re.compile(r"(?<![\w.:/‑-])[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z](?!\w)", re.I)
_DATE = re.compile(r"(?<!\d)\d{4}-\d\d-\d\d(?!\d)|\d\d?:\d\d")
_STRONG_PHONE = re.compile(
    r"\(?\+\d|\(0?\d{2,4}\)|(?:0\d{1,3}|\d{3})[-. ‑]\d{3,4}[-. ‑]\d{4}$|0\d{2,4}[/ ]\d{4,}|0\d{9,10}$|00\d{9,}"
)
_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?"
_PART = rf"(?:{_WORD}|[A-ZÀ-ÖØ-Þ]\.)"
_OF = r"(?:(?:von der|von|van der|van|de la|de los|de|del|zu) )?"
_FULL = rf"{_OF}{_PART}(?: {_OF}{_PART}){{0,3}}(?:, {_PART}(?: [A-Z]\.)?)?"
_KO = r"[가-힣]{2,5}"
#: Words that introduce or follow a name, number or address.
NAME_BEFORE = (
    r"(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? ", r"(?:Nurse|Technician|Doctor|Investigator|Professor|Physician|Therapist|Assistant|Volunteer|Caregiver|Coach|Teacher|Participant named) ", r"(?:[Mm]y|[Hh]is|[Hh]er|[Tt]heir) (?:sister|brother|neighbour|neighbor|wife|husband|mother|father|friend|colleague|son|daughter|partner) ",
    r"[Ss]poke with ", r"[Mm]y name is ", r"[Ss]igned,? ", r"(?:Reviewed|Checked|Entered|Handed over|Written|Signed|Approved|Reported) by ", r"(?:Contact|Author|Name|Kontakt|Contacto|Autor): ", r"Visit for ", r"\bname=", r"(?:Thanks|Regards|Cheers|Best|Danke|Gracias)[,.]?\s*\n",
    r"(?:Herr|Frau) ", r"Mein Name ist ", r"Gez\. ", r"(?:Meine|Mein|Unsere?) (?:Schwester|Bruder|Nachbar(?:in)?|Mutter|Vater|Frau|Mann) ", r"Gespräch mit ",
    r"(?:[Ll]a|[Ee]l) señora? ", r"[Mm]e llamo ", r"Firmado:? ", r"Hablé con ", r"[Mm]i (?:hermana|hermano|vecina|vecino|madre|padre|marido|mujer) ",
)
#: What people do, and things seldom: to say, ask, write, want, think, look, report, wear and exchange.
_DOES = "said the|says|asked for|asks|told|wrote|writes|wants the|wanted|thinks|thought|looked at|reported|swapped the|wore|sagt|sagte|fragt|fragte|schrieb|meldet|meldete|meint|trug|dice|dijo|pide|pidió|pregunta|preguntó|escribió|quiere|llevó"
NAME_AFTER = (rf" (?:{_DOES}) ", r" <", r" \(\+?\(?\d", r" wrote:")
KOREAN_NAMES = (rf"담당자 ({_KO})(?=[, ])", rf"작성자: ?({_KO})", rf"이름은 ({_KO})(?= ?입니다)", rf"(?<![가-힣])({_KO})(?= ?(?:씨|선생님))")
PHONE_WORDS = r"phone|call|text|\btel\b|telefon|teléfono|mobile|cell|reach|number is|callback|llame|avise|erreichbar|anrufen|전화|연락|문자|home:|work:"
ID_WORDS = r"ssn|social security|identity|insurance|\bid\b|\bident|dni|\bnie\b|steuer|주민|확인 번호|신분|passport|tax number"
OTHER_WORDS = r"checksum|batch|protocol|form \d|window|ratio|epoch|serial|seed|version|rows=|ts=|draw|cell "
ADDRESSES = (
    re.compile(r"(?<![\w-])\d{1,4}[A-Z]? (?:(?:St\.? )?[A-Z][\w'’]+ ){1,3}(?:Lane|Ln|Street|St|Close|Cl|Road|Rd|Avenue|Ave|Court|Ct|Way|Drive|Dr|Place|Pl|Terrace|Square|Sq|Row|Walk|Hill|Gardens|Crescent|Cres|Grove|Mews|Rise|Parade|Boulevard|Blvd|Alley|Circle|Parkway|Highway)\b(?!-)\.?"),
    re.compile(r"(?<![\w-])(?:(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zur|Zum|Unter den) )?(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|graben|ufer|ring|damm|hof|steig|zeile|stieg|pfad|chaussee|promenade|winkel)|(?:Alte|Neue|Große|Kleine|Lange|Kurze|Obere|Untere|Hohe|Breite)[rsn]? (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Zeile|Damm|Ring|Markt)) ?\d{1,4} ?[a-z]?(?!\w)"),
    re.compile(r"(?<![\w-])(?:Calle|C/|Plaza|Pza\.|Avenida|Avda\.|Paseo|Pº|Camino|Ronda|Travesía|Carrera|Glorieta) ?(?:de la |de los |de las |del |de )?[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+(?: (?:de la |de los |del |de )?[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+){0,3},? (?:n\.?º ?)?\d{1,4}"),
    re.compile(r"(?<![가-힣])[가-힣]+(?:시|군|도) (?:[가-힣]+(?:시|구|군|면|읍|동) ){1,2}[가-힣]+(?:대로|길|로) ?\d+(?:-\d+)?"),
)

_CAP = r"(?:(?:St|Str|Sta|Sto|Ave|Avda|Rd|Dr|Dra|Ln|Ct|Pl|Sq|[A-ZÀ-ÖØ-Þ])\.|[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ][\w'’]*)*)"
#: House number and capitalised words; capitalised words and house number.
_NUMBER_FIRST = rf"(?<![\w.:/-])\d{{1,5}}(?:-\d{{1,5}})?[A-Za-z]? (?>(?:(?:of|the|de|la|St\.) )?{_CAP}(?: (?:(?:of|the|de|la) )*{_CAP}){{0,4}})(?![\w-])"
_WORDS_FIRST = rf"(?<![\w-]){_CAP}(?:[ /](?:(?:de|la|los|las|del|der|den|dem|am|an|im|zum|zur|y|und) )*{_CAP}){{0,4}},? ?(?:n\.?º ?|Nr\.? ?)?\d{{1,4}}(?: ?[a-z])?(?![\w-])"
_FLAT = r"(?:[ ,\n]+(?:Apt|Apartment|Flat|Unit|Suite|Room)\.? ?#?\w{1,5})"
_TOWN = rf"{_CAP}(?: (?:(?:am|an|der|im|on|the|upon|de|la|del) )*{_CAP}){{0,3}}"
_CODE = r"(?i:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?)(?!\w)"
_BEFORE_TOWN = r"(?:, ?[\w.º]{1,8}(?: [\w.º]{1,8})?)?(?:, ?|\s*\n\s*)(?:[A-Z]{1,2}-)?\d{4,5} "
#: Words that introduce an address.
_AT_WORDS = r"(?:home|address|label|lives?|living|moved|residence|adresse|anschrift|abholung|abholen|lieferung|versand|wohn\w*|dirección|domicilio|entrega|vivo|vive|recogida|at|to|in|an|nach|en|a)(?: (?:is|in|at|to|an|en|a|ist|es))?[:,]? ?"
_AT_CUE = re.compile(rf"(?<!\w){_AT_WORDS}\Z", re.I)
_AT_START = re.compile(rf"{_AT_WORDS[:-1]}(?=(?-i:[A-ZÀ-ÖØ-Þ]))", re.I)
#: With a postcode behind, an address is sure from its shape.
SURE_ADDRESSES = (re.compile(rf"{_NUMBER_FIRST}(?={_FLAT}?(?:, ?|\s*\n\s*){_TOWN},? {_CODE})"), re.compile(rf"{_WORDS_FIRST}(?={_BEFORE_TOWN}{_CAP})"))
_LIKELY_ADDRESSES = (re.compile(rf"{_NUMBER_FIRST}(?={_FLAT}|,? {_CODE}|(?:, ?|\s*\n\s*)[A-ZÀ-ÖØ-Þ]\w\w)"), re.compile(r"(?<![가-힣])[가-힣]+(?:시|군|도) (?:[가-힣]+(?:시|구|군|면|읍|동|리) ){1,2}[가-힣]+ ?\d+(?:-\d+)?(?![\w])"))
_CUED_ADDRESSES = (re.compile(_NUMBER_FIRST), re.compile(_WORDS_FIRST))

#: Words with a capital that are no names.
_NO_NAME = re.compile(r"(?:Tel|Telefon|Telephone|Phone|Mobile|Cell|Home|Work|Call|Text|Teléfono|Thanks|Danke|Gracias|Contact|Kontakt|Contacto|The|Missed|Visit|Signed|Request|Question|Ticket|Schwester|Bruder|Nachbar|Nachbarin|Mutter|Vater|Mann|Kollege|Kollegin|Technikerin|Techniker)\b")
_TITLE = re.compile(r"^(?:mr|mrs|ms|miss|dr|prof|herr|frau|señora?|nurse|technician|doctor|investigator)\b\.? *|^(?:my|his|her|mein|meine|mi) \w+ ", re.I)
_BEFORE = [re.compile(rf"(?:{c})({_FULL})") for c in NAME_BEFORE]
_AFTER = [re.compile(rf"(?<![\w,.] )(?<![\w.])({_FULL})(?={c})") for c in NAME_AFTER]
_KOREAN = [re.compile(c) for c in KOREAN_NAMES]
#: What supports that a word is a name, right before and right after it.
_SUPPORT_BEFORE, _SUPPORT_AFTER = re.compile(rf"(?:{'|'.join(NAME_BEFORE)})\Z"), re.compile("|".join(NAME_AFTER))
_ARTICLE = re.compile(r"(?:The|An?|Der|Die|Das|Ein|Eine|El|La|Los|Las|Un|Una) ")
#: An introduction among capitals, which the model may take for the name's beginning.
_INTRODUCED = re.compile(r"(?:My|His|Her|Mein|Meine|Mi) \w+ |(?:Reviewed|Checked|Entered|Written|Signed|Approved|Reported|Handed Over) By |Visit For |Me Llamo |Mein Name Ist |My Name Is |Spoke With |Gespräch Mit |Hablé Con ")
#: Pronouns, which stand where names do.
_PRONOUN = re.compile(r"(?:I|You|He|She|It|We|They|One|Who|This|That|These|Those|Nobody|Somebody|Everybody|Anybody|No|Someone|Everyone|Anyone|Both|Each|Some|All|Nothing|Ich|Du|Er|Sie|Es|Wir|Ihr|Man|Wer|Niemand|Jemand|Das|Dies|Yo|Tú|Él|Ella|Nosotros|Nosotras|Ellos|Ellas|Usted|Ustedes|Nadie|Alguien|Esto|Eso|Ese|Esa)\Z")
_CUES = [(re.compile(w, re.I), t) for w, t in ((PHONE_WORDS, "phone"), (ID_WORDS, "id_number"), (OTHER_WORDS, ""))]
Span = tuple[int, int, str]


def plain_case(text: str) -> str:
    """The text, with capitals only at the start of words if it is nearly all capitals; as long as before."""
    letters = [c for c in text if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) > 0.85 * len(letters):
        titled = re.sub(r"[^\W\d_][\w'’]*", lambda m: m.group()[0] + m.group()[1:].lower() if len(m.group().lower()) == len(m.group()) else m.group(), text)
        return titled if len(titled) == len(text) else text
    return text


def number_spans(text: str) -> list[Span]:
    """Phone and identity numbers, told apart by the nearest telling word, or by shape where there is none."""
    out: list[Span] = [(*m.span(), "id_number") for m in LETTERED_ID.finditer(text)]
    lettered = list(out)
    for m in NUMBER.finditer(text):
        a, b = m.span()
        raw = m.group()
        if any(a < y and b > x for x, y, _ in lettered):
            continue
        if not 7 <= sum(c.isdigit() for c in raw) <= 17 or _DATE.search(raw) and not re.search(r"\d{6}", raw):
            continue
        if raw.startswith("(") and raw.count("(") > raw.count(")"):
            a, raw = a + 1, raw[1:]
        left, right = text[max(0, a - 32) : a], text[b : b + 28]
        left = left.rsplit("\n", 1)[-1]
        best: tuple[int, str] | None = None
        for cue, kind in _CUES:
            for c in cue.finditer(left):
                best = max(best or (-1, ""), (c.end(), kind))
        if best is None:
            best = next(((0, kind) for cue, kind in _CUES if kind and cue.search(right)), None)
        kind = best[1] if best else ("phone" if _STRONG_PHONE.match(raw) else "")
        if kind == "id_number" and raw.startswith(("+", "(")):
            kind = "phone"
        if kind:
            out.append((a, b, kind))
    return out


#: A word that begins a sentence or line, as Spark's own patterns are written.
OPENER = r"(?U)(?:^|[.!?>:] +|[\r\n]+)([A-ZÀ-ÖØ-Þ][\w'’]+)"


def _without_openers(name: str, openers: frozenset[str]) -> str:
    """A name of three words or more without last words that often begin sentences: the next sentence's, if no stop lies between."""
    words = name.split(" ")
    while len(words) > 2 and words[-1] in openers:
        words.pop()
    return " ".join(words)


def composed(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The text with composed accents, and where each of its characters begins and ends in the given one (None: as here)."""
    if unicodedata.is_normalized("NFC", text):
        return text, None, None
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    while at < len(text):
        end = at + 1
        # Marks, and the later parts of a Korean syllable, belong to the character before.
        while end < len(text) and (unicodedata.combining(text[end]) or "\u1160" <= text[end] <= "\u11ff"):
            end += 1
        for c in unicodedata.normalize("NFC", text[at:end]):
            out.append(c)
            starts.append(at)
            ends.append(end)
        at = end
    return "".join(out), starts, ends


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """An address without the introducing words before it."""
    while (m := _AT_START.match(text, a, b)) and m.end() < b:
        a = m.end()
    return a, b


def sure_addresses(text: str) -> list[tuple[int, int]]:
    """Addresses by the words for streets, and where there are none, by their shape with a postcode."""
    hits = [m.span() for rx in ADDRESSES for m in rx.finditer(text)]
    free = lambda a, b: all(b <= x or a >= y for x, y in hits)
    return hits + [s for rx in SURE_ADDRESSES for m in rx.finditer(text) if free(*(s := _trimmed(text, *m.span())))]


def likely_addresses(text: str) -> list[tuple[int, int]]:
    """Also those that a town, a flat, or an introducing word makes likely. For what a model took for addresses."""
    hits = sure_addresses(text)
    for rx in _LIKELY_ADDRESSES:
        hits += [m.span() for m in rx.finditer(text) if all(m.end() <= x or m.start() >= y for x, y in hits)]
    for rx in _CUED_ADDRESSES:
        for m in rx.finditer(text):
            a, b = _trimmed(text, *m.span())
            if all(b <= x or a >= y for x, y in hits) and (a > m.start() or _AT_CUE.search(text[max(0, a - 24) : a])):
                hits.append((a, b))
    return hits


def labels(text: str, roster: re.Pattern | None, openers: frozenset[str] = frozenset()) -> list[Span]:
    """Spans of a text for training, without overlaps. ``roster`` matches full names of known people, in any case."""
    whole, starts, ends = composed(text)
    seen = plain_case(whole)
    found: list[Span] = [(*m.span(), "email") for m in EMAIL.finditer(seen)]
    found += [(a, b, "street_address") for a, b in sure_addresses(seen)]
    found += number_spans(seen)
    for rx in [*_BEFORE, *_AFTER, *_KOREAN]:
        for m in rx.finditer(seen):
            title = _TITLE.match(m.group(1))
            if not title or title.end() < len(m.group(1)):
                a = m.start(1) + (title.end() if title else 0)
                found.append((a, a + len(_without_openers(seen[a : m.end(1)], openers)), "person_name"))
    found = [s for s in found if s[2] != "person_name" or not (_NO_NAME.match(seen[s[0] : s[1]]) or _PRONOUN.match(seen[s[0] : s[1]]) or _ARTICLE.match(seen[s[0] : s[1]]))]
    if roster is not None:
        found += [(*m.span(), "person_name") for m in roster.finditer(seen)]
    order = {t: i for i, t in enumerate(TYPES)}
    taken: list[Span] = []
    for s in sorted(found, key=lambda s: (order[s[2]] if s[2] != "street_address" else 0.5, -(s[1] - s[0]))):
        if all(s[1] <= t[0] or s[0] >= t[1] for t in taken):
            taken.append(s)
    return sorted(taken if starts is None else [(starts[a], ends[b - 1], k) for a, b, k in taken])


def roster_pattern(people: list[tuple[str, str]]) -> re.Pattern | None:
    """Full names of the roster: given and family name, an initial between, or family name first."""
    given = "|".join(sorted({re.escape(g) for g, _ in people if g}, key=len, reverse=True))
    family = "|".join(sorted({re.escape(f) for _, f in people if f}, key=len, reverse=True))
    if not given or not family:
        return None
    family = rf"(?:{family})(?:-(?:{family}))?"
    return re.compile(rf"(?<!\w)(?:(?:{given})(?: [A-Z]\.)? {family}|{family}, (?:{given})(?: [A-Z]\.)?)(?!\w)", re.I)


_EARLIER = re.compile(rf"(?<![\\w.])({_PART}) $")


#: Words between the parts of a name that may also begin it. "von" alone also means "from": it belongs to a name after a title or an initial.
_PARTICLE = re.compile(r"(?:(?:(?<=Herr )|(?<=Frau )|(?<=[A-Z]\. ))von|(?<!\w)(?:de la|de los|von der|van der)) $")
_WORD_BEFORE = re.compile(r"(?<!\w)([^\W\d_]+) $")


#: A number between letters that belong to identity numbers only.
_LETTERS_AROUND = re.compile(r"(?:[A-Z]{1,2}[ -]?)?(.*?)(?:[ -]?[A-Z])?\Z", re.S)


def _starts_here(text: str, at: int) -> bool:
    """Whether a sentence or line may begin here."""
    return bool(re.search(r"(?:\A|[.!?>:\]]\s*|\n\s*)\Z", text[max(0, at - 4) : at] if at else ""))


def _supported(text: str, a: int, b: int) -> bool:
    """Whether the words around say that this word is a name."""
    word = unicodedata.normalize("NFC", text[a:b])
    return not _PRONOUN.match(word) and not _NO_NAME.match(word) and bool(_SUPPORT_BEFORE.search(text[max(0, a - 32) : a]) or _SUPPORT_AFTER.match(text[b : b + 16]))


def confirmed(text: str, start: int, end: int, kind: str, openers: frozenset[str] = frozenset(), given: frozenset[str] = frozenset()) -> tuple[int, int] | None:
    """The exact bounds of a span that the model found, or None if its text can't be what the model says."""
    low, high = max(0, start - 48), min(len(text), end + 48)
    part, starts, ends = composed(text[low:high])
    hits: list[tuple[int, int]] = []
    if kind == "email":
        hits = [m.span() for m in EMAIL.finditer(part)]
    elif kind in ("phone", "id_number"):
        for m in NUMBER.finditer(part):
            a, b = m.span()
            if m.group().startswith("(") and m.group().count("(") > m.group().count(")"):
                a += 1
            if kind == "phone":
                letters = _LETTERS_AROUND.match(m.group())
                a, b = max(a, m.start() + letters.start(1)), m.start() + letters.end(1)
            if sum(c.isdigit() for c in m.group()) >= 7:
                hits.append((a, b))
        if kind == "id_number":
            hits += [m.span() for m in re.finditer(r"(?<![\w])[A-Z]{1,2} ?\d[\d -]{4,12}\d ?-?[A-Z]?(?!\w)", part)]
            hits += [m.span() for m in LETTERED_ID.finditer(part)]
    elif kind == "street_address":
        hits = likely_addresses(plain_case(part))
    else:
        # A name begins with a letter and ends with a whole word; in Korean words go on with particles.
        part_of = lambda c: c.isalnum() or unicodedata.combining(c) > 0
        a, b = start, end
        while 0 < a and part_of(text[a - 1]) and part_of(text[a]) and start - a < 24 and not "가" <= text[a] <= "힣":
            a -= 1
        while b < len(text) and (part_of(text[b]) or text[b] in "'’") and b - end < 24 and not "가" <= text[b] <= "힣":
            b += 1
        name = text[a:b]
        skip = len(name) - len(name.lstrip(" \t\r\n.,:;<>()\"'-"))
        a, name = a + skip, name[skip:]
        title = re.match(rf"{_NO_NAME.pattern}[,:.]?\s*", name) or _TITLE.match(name) or (_INTRODUCED.match(plain_case(name)) if name.isupper() else None)
        if title and title.end() < len(name):
            a, name = a + title.end(), name[title.end() :]
        name = name.rstrip(" \t\r\n,:;<>()\"'")
        # A full name begins with its first word: capitals just before belong to it.
        for _ in range(4):
            left = text[max(0, a - 40) : a]
            m = _PARTICLE.search(left)
            opens = lambda m: m.group(1) in openers and _starts_here(text, a - len(m.group()))  # noqa: E731, B023
            # Among capitals a capital says nothing.
            loud = lambda m: len(m.group(1)) > 2 and m.group(1).isupper() and name.isupper()  # noqa: E731, B023
            if not m and (m := _EARLIER.search(left)) and (_TITLE.match(m.group(1) + " ") or _NO_NAME.match(m.group(1)) or opens(m) or loud(m)):
                m = None
            if not m and (m := _WORD_BEFORE.search(left)) and (m.group(1).lower() not in given or opens(m)):
                m = None
            if not m:
                break
            name, a = text[a - len(m.group()) : a] + name, a - len(m.group())
        if len(name) < 2 or any(c.isdigit() or c in "_@=/" for c in name) or not any(c.isalpha() for c in name):
            return None
        single = not re.search(r"\s", name)
        if single and name[0].islower():
            return None
        # One word that often begins sentences, where a sentence may begin and nothing says that it is a name.
        if single and unicodedata.normalize("NFC", name.split("-")[0]) in openers and _starts_here(text, a) and not _supported(text, a, a + len(name)):
            return None
        return a, a + len(name)
    if starts is not None:
        hits = [(starts[a], ends[b - 1]) for a, b in hits]
    hits = [(a + low, b + low) for a, b in hits if a + low < end and b + low > start]
    return max(hits, key=lambda h: min(h[1], end) - max(h[0], start)) if hits else None
