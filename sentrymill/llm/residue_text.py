"""Text side of the residue operator: segments, slots, and the prefix trees of both.

Plain functions on strings, run inside Arrow batches. A *segment* is a sentence or line, a *slot* a
mark that a template engine or an author leaves where a value belongs, and a *template* a segment
whose values and slots are masked.
"""

from __future__ import annotations

import re

from sentrymill.llm.residue_words import VALUE, WILD, word_kinds

SLOT = ""
DEPTH = 4
#: Leading words that choose a leaf of the template tree, besides the number of tokens and the last one.
LEAD = 3
#: Share of equal tokens at which a segment joins a template of its leaf.
ALIKE = 0.7
#: Keys of a slot alone in its segment, of the start of a text, and of a slot that is residue whatever the corpus has.
BARE, START, MANY = "?", "^", "!"

_NAME = r"[A-Za-zÀ-ÿ_][\wÀ-ÿ.\-]*+(?: [\wÀ-ÿ.\-]++){0,3}"
_ASK = (
    r"insert|enter|add|your|fill(?: in)?|type|choose|select|name|date|time|todo|tbd|tba|tbc|placeholder|to be \w+|"
    r"bitte|hier|name|datum|uhrzeit|ort|ergänzen|eintragen|einfügen|ausfüllen|ihr\w*|"
    r"à|a|compléter|completer|remplir|insérer|votre|nom|completar|rellenar|insertar|introducir|su|nombre|fecha|hora|"
    r"inserire|compilare|preencher|inserir|вставьте|вставить|укажите|заполнить|введите"
)
#: Writings of a slot; each is a whole mark. Those of SLOT_FORMS begin with a sign, the others are looked for only in texts that hold a part of them.
SLOT_FORMS = (
    rf"\[\[\[?\s*{_NAME}\s*\]?\]\]",
    rf"\{{\{{\{{?[#/&^]?\s*{_NAME}(?:\s*\|\s*\w+)*\s*\}}?\}}\}}",
    rf"\{{%-?\s*{_NAME}\s*-?%\}}",
    rf"<%[=\-]?\s*{_NAME}\s*-?%>",
    r"<\?=?\s*\$?\w[\w \->\[\]'\"]*\?>",
    rf"<<\s*{_NAME}\s*>>",
    rf"&lt;\s*{_NAME}\s*&gt;",
    rf"[«‹]\s*{_NAME}\s*[»›]",
    rf"\$\{{\s*{_NAME}\s*\}}",
    rf"\$\(\s*{_NAME}\s*\)",
    rf"#\{{\s*{_NAME}\s*\}}",
    rf"@\{{\s*{_NAME}\s*\}}",
    rf"%\{{\s*{_NAME}\s*\}}",
    rf"%\(\s*{_NAME}\s*\)[sdif]",
    r"\{\d{1,2}\}",
    rf"\{{\s*{_NAME}\s*\}}",
    r"@@\s*\w[\w ]*?\s*@@",
    r"##\s*\w[\w ]*?\s*##",
    r"\*\|\s*\w+\s*\|\*",
    r"~\{\w+\}|\|\|\w+\|\|",
    r"%%?[A-Za-z][A-Za-z_]*%%?",
    r"%[sdif@]\b|%\d\$[sd]",
    rf"[\[【]\s*(?:{_ASK})(?=[\s:.…\]】])[^\[\]\n]{{0,40}}[\]】]",
    r"\[\s*[A-ZÀ-Ý][A-ZÀ-Ý]+(?:[ _\-][A-ZÀ-Ý]+){0,3}\s*\]",
    r"\[\s*[a-zß-ÿ]+(?:[ _\-][a-zß-ÿ]+){0,2}\s*\]",
    r"\[\s*(?:Datum|Uhrzeit|Name|Ort|Zahl|Nummer|Wert|Date|Heure|Nom|Lieu|Fecha|Hora|Nombre|Lugar)(?: [\wÀ-ÿ]+)?\s*\]",
    r"\(\s*(?:your|insert|enter|add|ihr\w*|votre|su|tu) [^()\n]{1,30}\)",
    r"<\s*(?!/)[A-Za-z][A-Za-z]*(?:[ _\-][A-Za-z]+){0,3}\s*>",
    r"\[object Object\]",
)
LINE_FORMS = (r"(?<!\w)__[A-Za-z][A-Za-z]*(?:_[A-Za-z]+)*__|_{3,}|\.{6,}|…{2,}", ("__", "......", "……"))
KEY_FORMS = (
    r"(?<![\w.])[a-z]+(?:[._][a-z]+)*\.(?:label|placeholder|title|text|name|value|field|message|caption)\b(?!\()",
    (".label", ".placeholder", ".title", ".text", ".name", ".value", ".field", ".message", ".caption"),
)
WORD_FORMS = (
    r"(?<!\w)(?<!\":)(?<!\": )(?:undefined|null|NaN|None|nil|NULL|XXX+|TBD|TBA|TBC|TK|N\.N\.)(?![\w-])",
    ("undefined", "null", "NaN", "None", "nil", "NULL", "XXX", "TBD", "TBA", "TBC", "TK", "N.N."),
)
_SIGNED = re.compile(r"(?=[\[{<&«‹$#@%*~|(【])(?:" + "|".join(f"(?:{f})" for f in SLOT_FORMS) + ")")
_CLOSED = re.compile(r"</([A-Za-z]+)>")  # <name> is an element there, no slot
_LINES, _KEYS, _WORDS = (re.compile(f) for f, _ in (LINE_FORMS, KEY_FORMS, WORD_FORMS))


def _slots(text: str, mark: str) -> str:
    closed = set(_CLOSED.findall(text)) if "</" in text else ()
    text = _SIGNED.sub((lambda m: m.group(0) if m.group(0)[1:-1] in closed else mark) if closed else mark, text)
    for pattern, (_, parts) in ((_LINES, LINE_FORMS), (_KEYS, KEY_FORMS), (_WORDS, WORD_FORMS)):
        if any(p in text for p in parts):
            text = pattern.sub(mark, text)
    return text


_TAG = re.compile(
    r"<!DOCTYPE[^>]*>|</?(?:html|head|body|title|meta|link|script|style|noscript|div|span|p|br|hr|h[1-6]|ul|ol|li|a|b|i|em|strong|center|table|tr|td|th|img|form|input|button|pre|nav|header|footer|article)\b[^<>]*/?>",
    re.I | re.S,
)
_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_QUOTED = re.compile(r"\"[^\"\n]*+\"|„[^„“”\n]*+[“”]|“[^“”\n]*+”")
_URL = re.compile(r"://\S+|(?<![\w>\]})%:/])/\S+|(?<!\w)[A-Za-z]:\\\S+|(?:\$HOME|%USERPROFILE%|%APPDATA%)[/\\]\S*")
_END = re.compile(r"([.!?。।؟…:;])\s+")
_UNSPACED = re.compile(r"([。।؟])(?=[^\n])")
_BREAK = re.compile(r"[\n\r\t]+")
_SPACES = re.compile(r"\s+")
_SLOTTED = re.compile(rf"[\w.,\-]*{SLOT}[\w\-]*(?:[^\w\s()\[\]]{SLOT}[\w\-]*)*")
_VALUED = re.compile(r"(?<![^\s()\[\]:;,=])[^\s()\[\]:;,=\d。।؟]*+\d[^\s()\[\];,=。।؟]*?(?=[)\].,;:!?…]{0,8}(?:\s|$)|[()\[\];,=。।؟])")
_WORD = re.compile(r"[^\W\d_]+", re.U)


def _without_comments(text: str) -> str:
    """The text without ``<!-- -->``; one that isn't closed stays."""
    parts = text.split("<!--")
    last = max((i for i, p in enumerate(parts) if "-->" in p), default=0)  # no later one is closed
    out, open_ = [parts[0]], False
    for i, p in enumerate(parts[1:], 1):
        if i > last:
            out += ["<!--", p]
        elif not open_ and "-->" not in p:
            open_ = True
        elif "-->" in p:
            out += ["\n", p.partition("-->")[2]]
            open_ = False
    return "".join(out)


def marked(text: str) -> str:
    """The text without markup, with one mark for each slot that isn't shown as code, quoted or inside an address, and one for each value."""
    if "<!--" in text:
        text = _without_comments(text)
    if "</" in text or "<br" in text:
        text = _TAG.sub("\n", text)
    text = _CODE.sub(lambda m: "\ncode0\n" if "\n" in m.group(0) else "code0", text)
    if "/" in text or "\\" in text:
        text = _URL.sub("addr0", text)
    text = _QUOTED.sub(lambda m: _slots(m.group(0), "quote0"), text)
    return _VALUED.sub(VALUE, _slots(text, SLOT))


def segments(text: str) -> list[str]:
    """Sentences, labels and lines: cut after their signs and at line ends and tabs."""
    text = _END.sub(r"\1\n", text)
    if "。" in text or "।" in text or "؟" in text:
        text = _UNSPACED.sub(r"\1\n", text)
    return [s for p in _BREAK.split(text) if (s := p.strip())]


def _masked_token(token: str) -> str:
    if SLOT not in token:
        return token
    return VALUE if len(token) == 1 else _SLOTTED.sub(VALUE, token)


def masked(segment: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """(template, tree keys of the segment, tree keys of its slots) of a marked segment.

    The template keeps one mask per value. The keys are nodes of a prefix tree of fixed depth over the
    masked tokens, runs of masks counting as one: ``<`` and the first 1 to DEPTH tokens, and ``>`` and
    three tokens from the second or third on, for what follows a value at the start. A slot is looked
    up at the node of the tokens before it, cut at DEPTH; one at the start at the node of those after it.
    Where nothing comes after it, it is looked up at its own token if that has a name (``snr=<*>``), else
    at BARE, which stands for the place that the segment before it leaves (see ``place``).
    """
    raw = _SPACES.split(segment)
    tokens = [_masked_token(t) for t in raw]
    path, slots = [], []
    for token, mask in zip(raw, tokens):
        mask = mask.rstrip(".,:;!?…") or mask
        if not (path and mask == VALUE and path[-1] == VALUE):
            path.append(mask)
        if SLOT in token:
            slots.append(len(path) - 1)
    keys = ["<" + " ".join(path[:n]) for n in range(1, min(DEPTH, len(path)) + 1)]
    keys += [">" + " ".join(path[n : n + 3]) for n in (1, 2, 3) if len(path) > n]
    if len(slots) >= 3:
        at = {MANY: None}
    else:
        at = {}
    if len(path) > 1:
        at |= dict.fromkeys(">" + " ".join(path[1:4]) if j == 0 else "<" + " ".join(path[: min(j, DEPTH)]) for j in slots)
    elif slots:
        at["<" + path[0] if _WORD.search(path[0]) else BARE] = None
    return " ".join(tokens), tuple(keys), tuple(at)


def place(template: str) -> str | None:
    """Tree key of what follows a template: ``^`` and its last DEPTH tokens, so that a label and its value are
    kept together though they are two segments. None if it is masks only, after which the place stays the same."""
    path: list[str] = []
    for token in reversed(template.split(" ")):
        mask = token.rstrip(".,:;!?…") or token
        if not (path and mask == VALUE and path[-1] == VALUE):
            if len(path) == DEPTH:
                break
            path.append(mask)
    if len(path) == 1 and VALUE in path[0] and not _WORD.search(path[0]):
        return None
    return "^" + " ".join(reversed(path))


def leaf(tokens: list[str]) -> str:
    """The leaf of the template tree that a segment belongs to: number of tokens, first words, last token. Masks are passed over, since logs begin with them."""
    words = [t for t in tokens if VALUE not in t][:LEAD]
    return f"{len(tokens)} {' '.join(words)} {tokens[-1]}"


class Leaf:
    """Templates of one leaf. A segment joins the template with most equal tokens, if they are ``ALIKE`` of all,
    and what differs becomes a wildcard; else it opens a template. Segments of up to three tokens stay as they are.

    Candidates are looked up by the tokens they share apart from those that chose the leaf.
    """

    def __init__(self) -> None:
        self.templates: list[list[str]] = []
        self.masked: list[dict[int, int]] = []  # per template the classes of the words behind each wildcard
        self._at: dict[tuple[int, str], list[int]] = {}

    def add(self, segment: str) -> int:
        tokens = segment.split(" ")
        n = len(tokens)
        if n > 3:
            shared: dict[int, int] = {}
            for key in enumerate(tokens):
                for k in self._at.get(key, ()):
                    shared[k] = shared.get(k, 0) + 1
            best, most = -1, 0
            for k in sorted(shared):
                if shared[k] > most:
                    best, most = k, shared[k]
            if most >= ALIKE * n:
                template = self.templates[best]
                masked = self.masked[best]
                for j, t in enumerate(tokens):
                    if template[j] == WILD:
                        masked[j] = masked[j] and (k := word_kinds(t)) and masked[j] | k
                    elif template[j] != t:
                        a, b = word_kinds(template[j]), word_kinds(t)
                        masked[j] = a | b if a and b else 0
                        self._at[(j, template[j])].remove(best)
                        template[j] = WILD
                return best
            for key in enumerate(tokens):
                self._at.setdefault(key, []).append(len(self.templates))
        self.templates.append(tokens)
        self.masked.append({})
        return len(self.templates) - 1
