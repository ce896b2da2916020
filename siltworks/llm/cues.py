"""Words by which pages mark what is not their own text, in six languages.

A cue is a short block dominated by stems of one kind: the stems are general (a verb of
sharing, a word for cookies, a word for rights), whole sentences are not listed. Length does
not switch a cue off: what counts is how dense the stems are among the words of the block.
A cue alone removes nothing; ``mainbody`` asks for repetition as well.
"""

from __future__ import annotations

import re

import ahocorasick

from .mojibake import _RUN, WRONG, _utf8

SHARE, BYLINE, CONSENT, LEGAL, SIDE, COMMENTS = range(1, 7)

# Stems; a leading blank means that a word starts with it, a trailing one that it ends there.
_SHARE = (
    " share |sharing| tweet| pin it| whatsapp| facebook| telegram| linkedin|e-mail |email | print | printer|copy link|copy url|send this|to a friend|tell a friend| follow | like us"
    "| teilen| drucken |weitersagen|link kopieren| folgen sie| folge | partage|imprimer|copier le lien| suivez| suivre |envoyer à"
    "| compartir| comparte|imprimir|copiar enlace|copiar el enlace| sigue | síguenos| seguir | partilh| compartilh|copiar ligação|copiar link| segue | siga |поделит|печать|копировать|скопировать|подписывайтесь на | читайте | следите за"
)
_DATA = (
    " cookie|cookies | tracker| tracking|privacy| consent|personal data|small files| datenschutz | datenschutzerklärung| datenschutzhinweis| einwilligung|témoins|traceur|confidentialité|vie privée|préférences|privacidad|privacidade|consentim|rastre|куки|cookie-|конфиденциальн|персональных данн"
)
_CHOICE = (
    " accept| agree| allow| decline| reject| manage| settings| preferences| policy| learn more| we use| uses | use of | choose| partners| improve| required| remember|akzeptier|zustimm|ablehn|einstellung| verwend| nutzt | nutzen | nötig| erforderlich| verbesser"
    "|accepter|refuser|paramétr|utilis|gérer|gérées|choix|améliorer|acept|rechaz|ajust|utiliza|uso de|configur|mejorar|aceit|recus|gerir|opções|melhorar|принять|принима|настро|использ|соглаша|правил|отклон"
)
_RIGHTS = (
    "©|copyright|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|direitos reservados|права защищены|imprint|impressum|terms | terms|conditions|legal | disclaimer|privacy| datenschutz | datenschutzerklärung| datenschutzhinweis| agb |nutzungsbeding|mentions légales|confidentialité|conditions générales|aviso legal|términos|privacidad|termos|privacidade|правила|конфиденциальност|условия"
    "|reproduc|republish|redistribut|nachdruck|vervielfält|reprodução|перепечат|воспроизвед|permission|genehmigung|autorisation|accord de|autorización|permiso|autorização|согласия|разрешен|prohibit|interdit|prohibid|proibid|запрещ|without warranty|no warranty|warrant|as is |of any kind|liability|gewähr|haftung|garantie|responsab|garantía|garantia|гаранти|ответственност|all rights|without permission|trademark|registered"
)
_SIDE = (
    "also like|also read|read also|read more|more from|more stories|related |most read|most popular| popular|trending|recommended|editor’s pick|editor's pick|sponsored|advertis|promoted|our newsletter|the newsletter|weekly letter|sign up|subscribe to|subscribe for|in your inbox"
    "|auch interessant|interessieren|lesen sie auch|mehr zum thema|meistgelesen|beliebt|empfohlen|anzeige|werbung|abonnier|rundbrief|plus lus|lire aussi|lire également|à découvrir|recommandé|sponsoris|publicité|abonnez|infolettre"
    "|te puede interesar|también te|más leíd|más vist|lea también|relacionad|recomendad|patrocin|publicidad|suscríb|boletín|mais lid|mais vist|veja também|leia também|publicidade|assine|boletim|читайте также|самое читаем|популярн|рекоменду|по теме|реклама|спонсор|рассылк|подпи"
)
_TALK = " comment| comments| kommentar| commentaire| comentario| comentário| комментари| repl| antwort| réponse| respuesta| resposta| ответ"
_BY = " by | von | par | por | автор| written by| posted by| verfasst| publié par| escrito"

_KINDS = {"s": _SHARE, "d": _DATA, "c": _CHOICE, "r": _RIGHTS, "x": _SIDE, "t": _TALK, "b": _BY}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    of: dict[str, str] = {}
    for kind, stems in _KINDS.items():
        for stem in stems.split("|"):
            of[stem] = of.get(stem, "") + kind
    for stem, kinds in of.items():
        a.add_word(stem, (kinds, len(stem)))
    a.make_automaton()
    return a


_STEMS = _automaton()
_DATE = r"(?:\d{1,4}[-./]\d{1,2}[-./]\d{2,4}|\d{1,2}\.? (?:de )?[^\W\d]+\.? (?:de )?\d{4}|[^\W\d]+\.? \d{1,2}, \d{4})"
_NAME = r"[^\d|·,.:;!?]{3,60}?"
_BYLINE = re.compile(
    rf"(?:by|von|par|por|автор:?|written by|posted by|verfasst von|publié par|escrito por) {_NAME},? ?[·|]? ?(?:updated |am |le |el |em |on )?(?:{_DATE})?(?: ?[·|] ?\d+ min(?:\.|utes)?(?: read)?)?|{_NAME} [|·] {_DATE}(?: [|·] \d+ min(?:\.|utes)?(?: read)?)?"
)
_YEAR = re.compile(r"(?:©|\(c\)|copyright) ?(?:\d{4}|[^\W\d])")
_COUNTED = re.compile(r"\d+ [^\W\d]+|[^\W\d]+ \(\d+\)")
_PUNCTUATION = ",.:;!?()[]·|“”„«»\"/"
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")


def plain(text: str) -> str:
    """Lower case, single spaces, without emphasis marks and arrows at the ends."""
    return " ".join(text.split()).lstrip("*_»># -").rstrip("*_» ").lower().replace("**", "")


_GARBLED = re.compile("[ÃÂâÐÑ√¬‚├┬Ô�][^\x00-\x7f]|�")


def mended(text: str) -> str:
    """Text whose runs were UTF-8 read in a common wrong encoding, read rightly; a lost sign stands for the middle dot."""
    if not _GARBLED.search(text):
        return text
    for _ in range(2):
        text = _RUN.sub(lambda m: next((x for name in WRONG[:4] if (x := _utf8(m.group(), name))), m.group()), text)
    return text.replace("�", "·")


def cue(text: str) -> int:
    """The kind of a block of plain text, 0 if none."""
    padded = f" {text} "
    for mark in _PUNCTUATION:
        if mark in padded:
            padded = padded.replace(mark, " ")
    found: dict[str, list[tuple[int, int]]] = {}
    for end, (kinds, n) in _STEMS.iter(padded):
        for k in kinds:
            found.setdefault(k, []).append((end - n + 1, n))
    words = text.count(" ") + 1
    if not found:
        return BYLINE if words <= 12 and _BYLINE.fullmatch(text) else 0
    size = {k: sum(n for _, n in _apart(v)) for k, v in found.items()}
    first = {k: min(s for s, _ in v) for k, v in found.items()}
    sentences = len(_SENTENCE.findall(text)) or 1
    if "x" in found and words <= 4 and size["x"] >= 0.5 * len(text):
        return SIDE
    # a call to share: it opens the block or fills a good part of it
    if "s" in found and words <= 9 * sentences and sentences <= 2 and (first["s"] <= 1 or size["s"] >= 0.3 * len(text)):
        return SHARE
    if words <= 12 and _BYLINE.fullmatch(text):
        return BYLINE
    if "r" in found and (_YEAR.match(text) or len(found["r"]) >= 2 and size["r"] >= 0.18 * len(text)):
        if not ("d" in found and "c" in found and len(found["c"]) >= len(found["r"])):
            return LEGAL
    if "d" in found and ("c" in found and words <= 14 * (len(found["d"]) + len(found["c"])) or words <= 4):
        return CONSENT
    if "r" in found and words <= 3 and size["r"] >= 0.6 * len(text):
        return LEGAL
    if "c" in found and len(found["c"]) >= 2 and words <= 8 and size["c"] >= 0.2 * len(text):
        return CONSENT
    if "c" in found and words <= 2 and size["c"] >= 0.6 * len(text):
        return CONSENT
    if "t" in found and words <= 4 and _COUNTED.fullmatch(text):
        return COMMENTS
    if "x" in found and words <= 9 and sentences <= 1 and size["x"] >= 0.25 * len(text):
        return SIDE
    return 0


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches without those inside others."""
    out, end = [], -1
    for s, n in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= end:
            out.append((s, n))
            end = s + n
    return out
