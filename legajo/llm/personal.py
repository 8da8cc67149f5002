"""Personal information in free text: found, scored and replaced.

Regular expressions propose spans.  Each proposal has a base score; validators
confirm or weaken it (Luhn, mod-97, mod-23 and mod-11 check digits, number
shapes of phones and identity papers), words before and after it raise or lower
it, and the column it stands in may add its own evidence.  Names are proposed
by capitals behind a title or a turn that introduces people, by an initial, or
by a listed given name; the list is one piece of evidence among these.  Overlapping proposals are
settled by score, then by length; those below ``ACCEPT`` are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.tables import table

ACCEPT = 0.5
#: Characters before and after a proposal that are searched for context words.
BEFORE, AFTER = 36, 24

#: Given names, in lower case.
GIVEN = """
adriana agustín alberto alejandra alejandro alfredo alicia amalia amparo ana andrea andrés ángel ángela anselmo antonia antonio
arturo aurora beatriz benjamín bernardo blanca bruno camila carla carlos carmen carola carolina catalina cecilia césar clara
claudia claudio cristina daniel daniela david delia diego dolores eduardo edwin efraín elena elías elisa elsa emilia emilio
enrique ernesto esteban esther eugenia eva fabiola federico felipe félix fermín fernanda fernando francisca francisco gabriel
gabriela gerardo germán gloria gonzalo graciela gregorio guadalupe guillermo gustavo héctor hernán hilda hugo ignacio inés irene
iris isabel ismael iván jaime javier jesús jimena joaquín jorge josé juan juana julia julián julio laura leonardo leticia lidia
lorena lourdes lucas lucía luis luisa manuel marcela marcelo marco margarita maría mariana mario marisa marta martín mateo
mauricio mercedes miguel miriam mónica natalia néstor nicolás noelia norma octavio ofelia olga orlando óscar pablo paola patricia
paula pedro pilar porfirio ramiro ramón raquel raúl rebeca renato ricardo rita roberto rocío rodrigo rolando rosa rosalba rosario
rubén ruth salomé samuel sandra santiago sara saúl sebastián sergio silvia simón sofía sonia susana teodoro teresa tomás ulises
valentina valeria vanessa verónica vicente víctor victoria vilma violeta viviana walter wilma ximena yolanda zulema
""".split()  # fmt: skip

_UP, _LOW = "A-ZÁÉÍÓÚÜÑÃÕÇÂÊÔ", "a-záéíóúüñãõçâêôà"
_given_names = set(GIVEN)
#: Given names that are also ordinary words; they count only when capitalised.
_WORDS = {"amparo", "ana", "aurora", "blanca", "clara", "dolores", "esteban", "eva", "gloria", "guadalupe", "iris", "luz", "marco", "mercedes", "norma", "pilar", "rita", "rocío", "rosa", "rosario", "sara", "salomé", "victoria", "violeta", "fabiola"}
#: Words of ordinary text and of page lines that follow a name; never part of one.
_STOP = "(?:con|por|en|de|del|al|a|ante|antes|que|sin|según|hasta|conforme|para|pese|dentro|bajo|después|y|o|e|el|la|los|las|como|desde|durante|entre|sobre|dejó|vive|titular|tel|cel|fono|celular|teléfono|número|presenta|acepta|carnet|nit|pasaporte|identidad|cédula|falta|solicitud|pesar|reverso|suscribe|recibido|enviar|ref|hoja|página|pág|folio|nota|acta|informe|oficina|unidad|entrega|expediente)\\b"


def _rest(word: str, particle: str) -> str:
    return f"{word}(?:\\s+{particle}\\s+{word}|\\s+{word})?"


#: Words of offices and roles, which a title may precede as well.
ROLES = frozenset("""
abogado abogada administrador administradora alcalde alcaldesa asistente auxiliar cliente comandante comisario comisión concejal consejero consejo contador contadora coordinador coordinadora
decano decana delegado delegada departamento dirección director directora distrito división embajador encargado encargada fiscal gerencia gerente gobernador inspector inspectora jefa jefatura jefe juez jueza
juzgado ministerio ministra ministro municipalidad notaria notario oficial oficina presidenta presidente procurador rector rectora responsable secretaria secretario secretaría servicio sindicato subdirector supervisor
tesorera tesorero unidad usuario vecino vecina viceministro ventanilla archivo mesa general nacional municipal provincial regional distrital
director board manager office clerk secretary president mayor judge chief head department
diretor diretora gerência secretária prefeito presidente chefe setor
""".split())  # fmt: skip

_STYLE_WORD = {
    "title": f"(?!(?i:{_STOP}))[{_UP}][{_LOW}]{{2,}}\\b",
    "upper": f"(?!(?i:{_STOP}))[{_UP}]{{3,}}\\b",
    "lower": f"(?!{_STOP})[{_LOW}]{{4,}}\\b",
}
_PARTICLE = {"title": "de", "upper": "(?:DE|de)", "lower": "de"}
_forward = {s: re.compile(f"\\s+({_rest(w, _PARTICLE[s])})") for s, w in _STYLE_WORD.items()}
_backward = {s: re.compile(f"\\b{w}(?:\\s+{w})?,\\s+$") for s, w in _STYLE_WORD.items()}
_initial = {
    "title": (0.75, re.compile(f"(?<![.\\w])[{_UP}]\\.\\s+{_rest(_STYLE_WORD['title'], 'de')}")),
    "upper": (0.65, re.compile(f"(?<![.\\w])[{_UP}]\\.\\s+{_rest(_STYLE_WORD['upper'], '(?:DE|de)')}")),
    "lower": (0.2, re.compile(f"(?<![.\\w])[{_LOW}]\\.\\s+{_rest(_STYLE_WORD['lower'], 'de')}")),
}
_BASE = {"title": 0.75, "upper": 0.75, "lower": 0.45}
_TITLE = r"(?i:\b(?:se[ñn]or(?:a|ita)?|sr|sra|srta|dr|dra|lic|ing|arq|don|do[ñn]a|dña|mr|mrs|ms|prof)\b\.?)\s+"
_LEAD = r"(?i:\b(?:comunicarse\s+con|contactar\s+a|hablar\s+con|entregado\s+a|recibido\s+por|firmado\s+por|atentamente,|quien\s+suscribe,|remitente:?|nombre(?:\s+completo)?:|attn:?|contact))\s+"
_shape = [
    (score, re.compile(f"{lead}((?:{_STYLE_WORD[style]})(?:\\s+(?:(?:de|del|la|las|los|DE|DEL|LA|da|do|dos)\\s+){{0,2}}{_STYLE_WORD[style]}){{{least},3}})"))
    for lead, score, least in ((_TITLE, 0.7, 1), (_LEAD, 0.55, 1)) for style in ("title", "upper")
]
_token = re.compile(r"[^\W\d_]{3,}")


def _shaped(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of two to four capitalised words behind a title or a
    turn that introduces a person, none of them a role."""
    for score, rule in _shape:
        for m in rule.finditer(text):
            words = m[1].split()
            at = next((i for i, w in enumerate(words) if w.lower() in ROLES), len(words))
            if at == len(words):
                yield m.start(1), m.end(1), score


def _names_in(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, base score) of proposals that hold a given name or an initial."""
    last = -1
    for m in _token.finditer(text):
        word = m.group()
        low = word.lower()
        if low not in _given_names or m.start() < last:
            continue
        style = "lower" if word == low else "upper" if word.isupper() else "title"
        if style == "lower" and (low in _WORDS or re.search(r"\w[-\u00ac\u00ad]\s*$", text[max(0, m.start() - 4) : m.start()])):
            continue
        left = text[max(0, m.start() - 60) : m.start()]
        back = _backward[style].search(left)
        if back and back.group().split(",")[0].split()[0].lower() not in _given_names:
            last = m.end()
            yield m.start() - len(left) + back.start(), last, _BASE[style]
            continue
        end = m.end()
        step = _forward[style].match(text, end)
        if step and step[1].split()[0].lower() in _given_names:  # a second given name
            first_end = step.start(1) + len(step[1].split()[0])
            again = _forward[style].match(text, first_end)
            step = again or step
        if step:
            last = step.end()
            yield m.start(), last, _BASE[style]
    for score, rule in _initial.values():
        for m in rule.finditer(text):
            yield m.start(), m.end(), score


_NAME_BEFORE = re.compile(r"(?i)(?:\b(?:sr|sra|srta|dr|dra|lic|ing|don|doña|señora?|ciudadan[oa]|por|entregado\s+a|recibido\s+por|declaró\s+que|quien\s+suscribe,|comunicarse\s+con|suscribe|remitente:?|nombre:?)\.?\s+|[\d\]-]\s+de\s+)$")
_BEGIN = re.compile(r"^\s*$")
_broken = re.compile(r"[-\u00ac=] ?\n\s*")
_NAME_SURELY = re.compile(r"(?i)^(?:\s+(?:vive|reside|dejó|firmó|declaró|entregó|recibió|compareció|solicitó|presentó)\b|,\s+(?:titular|con\s+(?:c\.?i|céd|carnet|ident|pasap|n\.?i\.?t)))")
_NAME_AFTER = re.compile(r"(?i)^\s*(?:,?\s*(?:tel|titular|con\s)|\(|dejó|vive|al\s+(?:tel|fono|cel|número)|c\.?i\.|$)")

_email = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?(?:\s?@\s?|\s?\(at\)\s?|\s?\[(?:arroba|at)\]\s?|\s?\(arroba\)\s?)(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b")

_S = r"(?:\s|-|\.)"
_phone_rules = [
    (0.9, re.compile(rf"(?<![\w+])(?:\+|00)591{_S}?\d{_S}?\d{{3}}{_S}?\d{{4}}(?!\w|[-.]\d)")),
    (0.9, re.compile(rf"(?<![\w+])(?:\+|00)591{_S}?\d{{4}}{_S}?\d{{4}}(?!\w|[-.]\d)")),
    (0.9, re.compile(rf"(?<![\w)])\(\+?591\)\s?\d{_S}?\d{{3}}{_S}?\d{{4}}(?!\w|[-.]\d)")),
    (0.9, re.compile(r"(?<![\w+(])\+\d{1,3}[\s.-]\(?\d{1,4}\)?(?:[\s.-]\d{2,4}){2,3}(?!\w|[-.]\d)")),
    (0.8, re.compile(r"(?<![\w+)])\([2-9]\d{2}\)\s?\d{3}[\s.-]\d{4}(?!\w|[-.]\d)")),
    (0.55, re.compile(r"(?<![\w+/.,)-])(?<!\d\s)(?:\d{3}-\d{5}|\d{3}\.\d{2}\.\d{3})(?!\w|[-.,/]\d|\s\d)")),
    (0.4, re.compile(r"(?<![\w+/.,)-])(?<!\d\s)(?:\d{4}\s\d{4}|\d{8})(?!\w|[-.,/]\d|\s\d)")),
    (0.3, re.compile(r"(?<![\w+/.,)-])(?<!\d\s)\d{3}[ .-]\d{4}(?!\w|[-.,/]\d|\s\d)")),
]
_PHONE_BEFORE = re.compile(r"(?i)(?:\b(?:tel|tels|fono|cel|celular|teléfono|telf|móvil|whatsapp|ref|llamó\s+desde\s+el|consultas:|contacto:?)\b[.:]?\s*|\bal\s+número\s+|(?:@|\bat\)|arroba\])[\s\w.-]+(?:\s/|\s+o)\s+|^\s*)$")
_PHONE_NOT = re.compile(r"(?i)(?:comprobante|guía|despacho|lote|folio|código|formulario|memorándum|oficio|recibo|factura|expediente|voucher|vale|cuenta|unidades|\bbs\.?|monto|serie|registro|trámite|nota|acta|resolución|\bn[°ºo]\.?|\bnro\.?)\s*(?:n[°ºo]\.?|nro\.?|:)?\s*$")

_D = "[0-9OoIlSBZ]"  # digits and the letters they are misread as, behind a label only
_LABEL = r"(?i:\b(?:c[eé]dula(?:\s+de\s+(?:identidad|extranjer[oí]a?))?|c\.\s?[iIl1]\.(?:\s*extranjero)?|c[iIl]\b(?:\s*extranjero)?|carnet(?:\s+de\s+identidad)?|identidad|pasaporte|d\.?n\.?i\.?|n\.\s?[iIl1]\.\s?t\.|n[iIl1]t))\s*:?\s*(?:(?:[nN][°ºo]|[nN]ro|NRO|NO)\.?\s*)?:?\s*"
_id_labelled = re.compile(
    rf"{_LABEL}(?P<v>[A-Z]{{1,2}}-?{_D}{{6,8}}|\d{{1,3}}(?:\.\d{{3}}){{2}}(?:-\d?[A-Z])?|\d{{4}}\s\d{{3}}\s\d{{2,5}}|\d{{4}}\s\d{{3}}|\d{{5,8}}-\d?[A-Z]|\d{_D}{{5,13}})(?![\w]|[-.]\d)"
)
_id_bare = [
    (0.55, re.compile(r"(?<![\w.,/-])(?:\d{7}-\d[A-Z]|E-\d{7}|[A-Z]{2}\d{7})(?![\w/-])")),
    (0.3, re.compile(r"(?<![\w.,/+)-])(?<!\d\s)(?:\d\.\d{3}\.\d{3}|\d{4}\s\d{3}(?:\s\d{2,5})?|\d{7}|\d{9,12})(?!\w|[-.,/]\d|\s\d)")),
]
_ID_BEFORE = re.compile(r"(?i)(?:titular\s+de\s*|\bdocumento:?\s*|^\s*|\(\s*)$")
_ID_NOT = re.compile(r"(?i)(?:comprobante|guía|despacho|lote|folio|código|formulario|memorándum|oficio|recibo|factura|expediente|voucher|vale|\bbs\.?|monto|serie|interno|\bn[°ºo]\.?|\bnro\.?)\s*(?:n[°ºo]\.?|nro\.?|:)?\s*$")
_NOT_AFTER = re.compile(r"(?i)^\s*(?:unidades|bs\b|%|/)")

_id_checked = [  # (validator, shape): national numbers with check letters or digits
    ("mod23", re.compile(r"(?<![\w.-])\d{2}\.?\d{3}\.?\d{3}[ -]?[A-Z](?![\w-])")),
    ("mod11", re.compile(r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])")),
]
_social = re.compile(r"(?<![\w.,/+-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w/-])")
_card = re.compile(r"(?<![\w.-])(?:(?:\d{4}[ -]?){3}\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\w-])")
_iban = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)")

_CAP = f"(?!(?i:no|nro|km|núm)\\b)(?:[{_UP}][{_LOW}]+|[{_UP}]{{2,}})"
_STREET = rf"(?:\b(?i:calle|avenida|pasaje|carretera|jirón|plaza|plazuela|camino|callejón|rua|travessa|praça)|\b(?i:av|avda|jr|psje|pje|ctra)\.|\b[cC]/)\s*"
_street = re.compile(rf"{_STREET}{_CAP}(?:\s+(?:(?i:de|del|la|las|los|el|y)\s+){{0,2}}{_CAP}){{0,3}}")
_number_first = re.compile(r"(?<![\w.,/-])\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Lane|Court|Square)\b\.?")
_street_words = ("calle", "avenida", "pasaje", "carretera", "jirón", "plaza", "plazuela", "camino", "callejón", "rua", "travessa", "praça", "av.", "avda.", "jr.", "psje.", "pje.", "ctra.", "c/")
_house = re.compile(r"(?i)^,?\s+(?:(?:n[°º]|no\.|nro\.?|núm\.?|#)\s*\d{1,5}|km\.?\s*\d{1,4}|\d{1,5})(?![\w]|[.,/-]\d)|^,?\s*#\s*\d{1,5}(?!\w|[.,/-]\d)")


def streets(text: str) -> list[re.Match]:
    """Street words with the name behind them, numbered or not."""
    low = text.lower()
    return list(_street.finditer(text)) if any(w in low for w in _street_words) else []


@dataclass(slots=True)
class Span:
    start: int
    end: int
    kind: str
    score: float
    #: name of the checksum that holds, if one was applied
    check: str = ""


def luhn(digits: str) -> bool:
    """Whether the check digit of a card-like number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an international account number's check digits hold."""
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def mod23(code: str) -> bool:
    """Whether the check letter of an eight-digit national number holds."""
    digits, letter = re.sub(r"\D", "", code), code[-1]
    return len(digits) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter


def mod11(code: str) -> bool:
    """Whether both check digits of an eleven-digit taxpayer number hold."""
    d = [int(c) for c in code if c.isdigit()]
    if len(d) != 11 or len(set(d)) == 1:
        return False
    return all(d[n] == sum(x * w for x, w in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10 for n in (9, 10))


_CHECKS = {"mod23": mod23, "mod11": mod11}


def proposals(text: str, hint: str = "") -> list[Span]:
    """Scored spans of ``text``; ``hint`` is what its column or field says it is
    (``identity_number`` where a field of that kind was read)."""
    out: list[Span] = []
    hidden: list[tuple[int, int]] = []
    for m in _email.finditer(text):
        out.append(Span(*m.span(), "email", 0.95))
    for m in streets(text):
        house = _house.match(text[m.end() : m.end() + 20])
        hidden.append((m.start(), m.end()))
        if house:
            out.append(Span(m.start(), m.end() + house.end(), "street_address", 0.9))

    for m in _number_first.finditer(text):
        hidden.append(m.span())
        out.append(Span(*m.span(), "street_address", 0.85))

    def before(start: int) -> str:
        return text[max(0, start - BEFORE) : start]

    if any(c.isdigit() for c in text):
        for m in _iban.finditer(text):
            if mod97(re.sub(r"\s", "", m.group())):
                out.append(Span(*m.span(), "account_number", 0.98, "mod97"))
        for m in _card.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(*m.span(), "card_number", 0.85, "luhn"))
        for check, rule in _id_checked:
            for m in rule.finditer(text):
                if _CHECKS[check](m.group()):
                    out.append(Span(*m.span(), "identity_number", 0.9, check))
        for m in _social.finditer(text):
            left = before(m.start())
            out.append(Span(*m.span(), "identity_number", 0.6 - 0.6 * bool(_ID_NOT.search(left)) - 0.6 * bool(_NOT_AFTER.match(text[m.end() : m.end() + AFTER]))))
        for m in _id_labelled.finditer(text):
            if sum(c.isdigit() for c in m["v"]) >= 5:
                out.append(Span(*m.span("v"), "identity_number", 0.92))
        for score, rule in _id_bare:
            for m in rule.finditer(text):
                left = before(m.start())
                score_here = score + 0.35 * bool(_ID_BEFORE.search(left)) - 0.6 * bool(_ID_NOT.search(left)) - 0.6 * bool(_NOT_AFTER.match(text[m.end() : m.end() + AFTER]))
                out.append(Span(*m.span(), "identity_number", score_here))
        if hint == "identity_number":
            m = re.match(rf"\s*(\d{{4}}\s\d{{3}}(?:\s\d{{2,5}})?|{_D}{{7,14}})(?!\w|[-.]\d)", text)
            if m and sum(c.isdigit() for c in m[1]) >= 5:
                out.append(Span(*m.span(1), "identity_number", 0.93))
        for score, rule in _phone_rules:
            for m in rule.finditer(text):
                left = before(m.start())
                own = score + 0.4 * bool(_PHONE_BEFORE.search(left)) - 0.6 * bool(score < 0.9 and _PHONE_NOT.search(left)) - 0.6 * bool(_NOT_AFTER.match(text[m.end() : m.end() + AFTER]))
                out.append(Span(*m.span(), "phone", own))
    mails = [(s.start, s.end) for s in out if s.kind == "email"]
    for a, b, score in _names_in(text):
        if any(x < b and a < y for x, y in hidden) or any(x < b and a < y for x, y in mails):
            continue
        left, right = _broken.sub("", before(a)), text[b : b + AFTER]
        own = score + (0.35 if _NAME_BEFORE.search(left) else 0.2 * bool(_BEGIN.match(left))) + (0.35 if _NAME_SURELY.match(right) else 0.15 * bool(_NAME_AFTER.match(right)))
        out.append(Span(a, b, "name", own))
    for a, b, score in _shaped(text):
        if not any(x < b and a < y for x, y in (*hidden, *mails)):
            out.append(Span(a, b, "name", score + 0.1 * bool(_NAME_SURELY.match(text[b : b + AFTER]))))
    return out


def find(text: str | None, hint: str = "") -> list[Span]:
    """Accepted spans of ``text``, in order and without overlap; null and empty
    texts have none."""
    if not text:
        return []
    taken: list[Span] = []
    for s in sorted(proposals(text, hint), key=lambda s: (-min(s.score, 0.9), -(s.end - s.start), s.start)):
        if s.score >= ACCEPT and all(s.end <= t.start or t.end <= s.start for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: s.start)


def mention(text: str, span: Span) -> str:
    """The mention as written, any line break in it as one space."""
    return re.sub(r"\s*[\r\n\f]+\s*", " ", text[span.start : span.end])


def redact(text: str | None, hint: str = "") -> str | None:
    """``text`` with each mention replaced by ``[TYPE]``."""
    if not text:
        return text
    out, at = [], 0
    for s in find(text, hint):
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, rec_id, item_no, hint, text of the three kinds of value."""
    rec = table(spark, sf_dir, "recognitions")
    text = rec.where("strategy = 'rgb-original'").select(F.lit("text").alias("field"), F.col("recognition_id").alias("rec_id"), F.lit(0).alias("item_no"), F.lit("").alias("hint"), "text")
    item = rec.select("recognition_id", F.posexplode("structured_fields.fields").alias("p", "f"))
    raw = item.select(F.lit("raw").alias("field"), F.col("recognition_id").alias("rec_id"), (F.col("p") + 1).alias("item_no"), F.when(F.col("f.field_type").isin("NIT", "CI", "PASAPORTE", "DOCUMENTO"), "identity_number").otherwise("").alias("hint"), F.col("f.raw").alias("text"))
    value = table(spark, sf_dir, "semantic_fields").select(F.lit("value").alias("field"), F.col("field_id").alias("rec_id"), F.lit(0).alias("item_no"), F.lit("").alias("hint"), F.col("value").alias("text"))
    return text.unionByName(raw).unionByName(value).where("text is not null")


FOUND = "field string, rec_id bigint, item_no int, pii_type string, found string"
#: The types that the found query reports.
TYPES = ("email", "phone", "identity_number", "street_address", "name")


def found(df: DataFrame) -> DataFrame:
    """Distinct mentions of each row of ``df`` (field, rec_id, item_no, hint, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for field, rec, item, hint, text in zip(*(c.to_pylist() for c in b.columns)):
                for kind, words in {(s.kind, mention(text, s)): None for s in find(text, hint) if s.kind in TYPES}:
                    for column, x in zip(rows, (field, rec, item, kind, words)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())], names=["field", "rec_id", "item_no", "pii_type", "found"])

    return df.select("field", "rec_id", "item_no", "hint", "text").mapInArrow(run, FOUND)


def confirmed(df: DataFrame) -> DataFrame:
    """Distinct mentions whose check digits hold, with the name of the check:
    cards (Luhn), accounts (mod-97), national numbers (mod-23, mod-11)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for field, rec, item, hint, text in zip(*(c.to_pylist() for c in b.columns)):
                for own in {(s.kind, mention(text, s), s.check): None for s in find(text, hint) if s.check}:
                    for column, x in zip(rows, (field, rec, item, *own)):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["field", "rec_id", "item_no", "pii_type", "found", "confirmed_by"])

    return df.select("field", "rec_id", "item_no", "hint", "text").mapInArrow(run, f"{FOUND}, confirmed_by string")


def redacted(df: DataFrame) -> DataFrame:
    """field, rec_id, item_no and the text with placeholders, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [redact(t, h) for h, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(text, pa.string())], names=["field", "rec_id", "item_no", "text"])

    return df.select("field", "rec_id", "item_no", "hint", "text").mapInArrow(run, "field string, rec_id bigint, item_no int, text string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of a person or of how to reach one."""
    return found(sources(spark, sf_dir))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its mentions replaced by typed placeholders."""
    return redacted(sources(spark, sf_dir))


def p6_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention that a checksum confirms."""
    return confirmed(sources(spark, sf_dir))
