"""Template residue and error-page text.

A multi-pattern automaton (Aho-Corasick) holds short stems in six languages: states of failure
(not found, denied, timed out), words for scripts and what is asked of them, and filler. No
whole sentence is listed. A sentence is covered if it holds a failure, or a word for scripts
beside a request. A record is residue if

- its text, apart from menus, legal lines and the like, is covered to at least ``COVERED`` by
  error or script sentences; a heading that is itself mostly a failure or request also covers
  the few sentences of names and numbers that follow it (``REACH`` characters), or
- one of its paragraphs is covered to at least ``FILLER`` by filler, or
- an unfilled placeholder stands in its text outside code blocks.

A page that only writes about such things has low coverage and stays. Where a page shows
nothing else, its noscript text counts.

Defined results: null and empty texts, and pages whose text is only menus, are no residue;
status codes do not count; repeated rows are each judged; whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import html_blocks, noscript_texts
from ..session import table
from .cues import cue, plain

COVERED, FILLER = 0.75, 0.6
#: Share of a block from which a failure or request makes it a heading of a notice, and the characters that it then covers.
HEADING, REACH = 0.25, 240
#: Words of a block that may be a menu entry or a heading of a notice.
SHORT = 6

#: States of failure.
ERROR = (
    "not found|nothing here|nothing was found|nothing found|can't be found|cannot be found|couldn't find|could not find|can't find|isn't available|is not available|not available|no longer|does not exist|doesn't exist|been moved|been removed|been deleted|gone for good|used to live|page is missing"
    "|forbidden|access denied|been denied|permission denied|not have permission|don't have permission|not authori|unauthori|not allowed to|bad request|bad gateway|gateway time|timeout|timed out|took too long|took longer|gave up|server error|internal error|unavailable|maintenance|back shortly|be back soon|overloaded|under heavy load"
    "|too many requests|rate limit|slow down|requests in a short|quota|used up|session expired|session has expired|has expired|sign in once more|sign in again|log in again|went wrong|unexpected error|unexpected condition|error occurred|an error|could not complete|couldn't complete|could not reach|couldn't reach|can't be reached|can't be displayed|could not be loaded|failed to load"
    "|fatal error|uncaught|exception|stack trace|call stack|traceback|unknown variable|template error|syntax error|parse error|error establishing|refused the connection|connection refused|connect failure|connection failure|connection reset|upstream|try again|please retry|has been told|been notified|been suspended|contact the provider|contact the administrator|contact support"
    "|nicht gefunden|existiert nicht|existiert leider nicht|nicht verfügbar|nicht erreichbar|verweigert|blockiert|serverfehler|fehler ist|ein fehler|wartungsarbeiten|zeitüberschreitung|versuchen sie es|abgelaufen|gesperrt|zu viele anfragen"
    "|introuvable|n'existe pas|n'existe plus|accès refusé|accès interdit|erreur|indisponible|non disponible|réessayez|réessayer|a expiré|maintenance|retournez à|délai dépassé|suspendu"
    "|no encontrad|no existe|no está disponible|no disponible|acceso denegado|prohibido el acceso|error interno|error del servidor|se ha producido un error|inténtelo|vuelva a intentar|ha caducado|ha expirado|mantenimiento|demasiadas solicitudes"
    "|não encontrad|não existe|não está disponível|indisponível|acesso negado|erro interno|erro do servidor|ocorreu um erro|tente novamente|expirou|manutenção|muitas solicitações"
    "|не найден|не существует|недоступ|доступ запрещ|доступ ограничен|ошибка|вернитесь на|попробуйте|повторите|истекл|технические работы|слишком много запросов|ничего нет"
).split("|")
#: Words for scripts; a browser check by name.
SCRIPT = "javascript|java script|scripts|scripting|js on |js is |cookies|your browser|ваш браузер".split("|")
CHECK = "not a robot|are human|you're human|checking your browser|checking if the site|browser not supported|unsupported browser|browser is not supported|browser is out of date|captcha|javascript required|requires javascript|kein roboter|pas un robot|no eres un robot|não é um robô|не робот".split("|")
#: What is asked of scripts, or what ails them.
REQUEST = (
    "enable|turn on|turn them on|turned on|switch|allow|activate|required|requires|need|must|disabled|blocks|blocked|without|support|reload|verify|aktivier|einschalten|erforderlich|benötig|muss|deaktiviert|bitte|activer|activez|veuillez|nécessit|désactiv|requis|habilit|activar|active |ative |necesit|necessári|desactivad|requiere|requer|включ|необходим|требует|отключ|разреш"
).split("|")
FILLER_PHRASES = (
    "lorem ipsum dolor", "placeholder copy", "placeholder text", "dummy text", "sample text", "filler text", "text goes here", "your text here", "copy goes here", "layout only", "blindtext", "platzhaltertext", "asdf asdf", "texto de relleno", "texto de ejemplo", "texto de exemplo", "texto de preenchimento", "faux texte", "texte de remplissage", "здесь будет текст", "текст-заполнитель", "рыбный текст",
)
#: Vocabulary of pseudo-Latin filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}|\$!?\{[A-Za-z_][\w.\[\]]*\}|#\{[A-Za-z_][\w.]*\}|(?<![\w%])%{1,2}[A-Z][A-Z_0-9]{2,}%{1,2}(?![\w%])|\{%[^%\n]{1,80}%\}|\[(?:INSERT|YOUR|ENTER|ADD) [A-Z _]+\]|\[Your [A-Z][\w ]+\]|\[object Object\]|@@[A-Z_]{3,}@@|::[A-Z][A-Z_]{2,}::|«[a-z]+_[a-z_]+»|<%=?[^%\n]{1,60}%>|(?<![\w%])%[a-z][a-z_]{1,30}%(?![\w%])|\[(?:(?:First|Last|Full|Middle|Your|Company|Customer|Client|User|Product|Project|Event|Insert|Recipient|Sender|Street|Phone|Email) ){1,2}(?:Name|Title|Address|Number|Date|Here|Email|Company|City|Link|Text)\](?![(\[])|(?<![\w_^}\\])\{[0-9]\}(?![\w^_{])"
)
_FENCED = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_SENTENCE = re.compile(r"[^.!?…]*[.!?…]+|[^.!?…]+$")
_WORDS = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_LATEX = re.compile(r"\$\$.*?\$\$|\\begin\{.*?\\end\{\w+\}", re.S)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    # words of six letters or more of pseudo-Latin mark where filler has to be looked for
    for kind, stems in (("e", ERROR), ("n", SCRIPT), ("s", CHECK), ("r", REQUEST), ("f", FILLER_PHRASES), ("l", [w for w in _LATIN if len(w) >= 6])):
        for p in sorted(set(stems)):
            known = a.get(p, ("", len(p)))[0]
            a.add_word(p, (known + kind, len(p)))
    a.make_automaton()
    return a


class Judge:
    def __init__(self) -> None:
        self.phrases = automaton()

    def hits(self, text: str) -> list[tuple[str, int, int]]:
        return [(k, end - n + 1, end + 1) for end, (kinds, n) in self.phrases.iter(text) for k in kinds]

    def is_filler(self, block: str) -> bool:
        low = block.lower()
        found = [s for kind, s, _ in self.hits(low) if kind == "f"]
        filler = words = 0
        for m in _SENTENCE.finditer(low):
            ws = _WORDS.findall(m.group())
            words += len(ws)
            if any(m.start() <= s < m.end() for s in found) or len(ws) >= 4 and sum(w in _LATIN for w in ws) >= 0.8 * len(ws):
                filler += len(ws)
        return filler >= 6 and filler >= FILLER * words

    def covered(self, text: str, found: list[tuple[str, int, int]]) -> tuple[int, int]:
        """(characters of the sentences that tell of a failure or ask for scripts, characters of the stems there)."""
        total = stems = 0
        for m in _SENTENCE.finditer(text):
            here = [(k, s, e) for k, s, e in found if m.start() <= s < m.end()]
            kinds = {k for k, _, _ in here}
            if kinds & {"e", "s"} or {"n", "r"} <= kinds:
                total += len(m.group().strip())
                stems += len({c for k, s, e in here if k in "ensr" for c in range(s, e)})
        return total, stems

    def is_notice(self, blocks: list[str]) -> bool:
        """Whether the blocks, apart from menus, cues and short headings, are error or script notices."""
        texts = [block.lower().replace("’", "'") for block in blocks]
        kinds = [set("".join(ks for _, (ks, _) in self.phrases.iter(t))) for t in texts]
        strong = [bool(k & {"e", "s"}) or {"n", "r"} <= k for k in kinds]
        if not any(strong):
            return False
        texts = [plain(_LINK.sub(r"\1", t) if "](" in t else t) for t in texts]
        # long blocks of other text rule most pages out before all blocks are read
        most = sum(len(t) + REACH for t, x in zip(texts, strong) if x)
        others = sum(len(t) for t, x in zip(texts, strong) if x)
        for t in sorted((t for t, x in zip(texts, strong) if not x), key=len, reverse=True):
            if most < COVERED * others:
                return False
            if len(t) < 40:
                break
            others += 0 if cue(t) or is_menu(t) else len(t)
        total = hit = reach = 0
        for text, told in zip(texts, strong):
            part, stems = self.covered(text, self.hits(text)) if told else (0, 0)
            if part:
                # what is mostly a failure explains the names and numbers of its block and after it
                if stems >= HEADING * len(text):
                    reach = REACH
                hit += part
                rest = len(text) - part
            elif cue(text) or is_menu(text):
                continue
            else:
                rest = len(text)
            total += len(text)
            taken = min(rest, reach)
            hit += taken
            reach -= taken
        return hit > 0 and hit >= COVERED * total

    def kinds(self, blocks: list[str], text: str, hidden: list[str]) -> list[str]:
        """What of 'placeholder', 'filler' and 'notice' a record shows; text is its text without code blocks."""
        out = []
        seen = "".join(kinds for _, (kinds, _) in self.phrases.iter(text.lower().replace("’", "'")))
        if PLACEHOLDER.search(text):
            out.append("placeholder")
        if ("f" in seen or seen.count("l") >= 3) and any(self.is_filler(b) for b in blocks):
            out.append("filler")
        if set(seen) & set("esn") and self.is_notice(blocks):
            out.append("notice")
        elif hidden and not blocks and self.is_notice(hidden):
            out.append("notice")
        elif hidden and blocks and all(cue(plain(b)) or is_menu(plain(b)) for b in blocks) and self.is_notice(hidden):
            out.append("notice")
        return out


def is_menu(text: str) -> bool:
    """A short block without a sentence, or a list of such."""
    parts = re.split(r" [|·] |  +", text) if (" | " in text or " · " in text) else [text]
    return all(len(p.split()) <= SHORT and not p.rstrip().endswith((".", "!", "?", ":")) for p in parts)


def markdown_blocks(text: str) -> list[str]:
    return [s for line in _FENCED.sub("\n", text).split("\n") if (s := line.strip(" \t\r\n\f"))]


def without_code(page: str) -> str:
    return "\n".join(b.text for b in html_blocks(page) if not any(p.split(".")[0] == "pre" for p in b.path))


def _judged(judge: Judge, tab: str, text: str) -> list[str]:
    if tab == "raw_page":
        found = html_blocks(text)
        blocks = [b.text for b in found if not any(p.split(".")[0] == "pre" for p in b.path)]
        hidden = noscript_texts(text) if "noscript" in text.lower() else []
        return judge.kinds(blocks, "\n".join(blocks), hidden)
    bare = _FENCED.sub("\n", text)
    return judge.kinds([s for line in bare.split("\n") if (s := line.strip(" \t\r\n\f"))], _LATEX.sub(" ", _EMPH.sub("", bare)), [])


_EMPH = re.compile(r"[*`]|\]\([^)]*\)")


def residue(records: DataFrame) -> DataFrame:
    """(tab, rec_id, kinds) of the records (tab, rec_id, text) that show residue; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            kinds = [",".join(_judged(judge, tab, text)) for tab, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string())], names=["tab", "rec_id", "kinds"])
            yield found.filter(pa.array([bool(k) for k in kinds], pa.bool_()))

    return records.mapInArrow(run, "tab string, rec_id bigint, kinds string")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, text) of all pages and items with text."""
    one = table(spark, sf_dir, "raw_page").select(F.lit("raw_page").alias("tab"), F.col("page_id").alias("rec_id"), F.col("html").alias("text"))
    two = table(spark, sf_dir, "batch_item").select(F.lit("batch_item").alias("tab"), F.col("item_id").alias("rec_id"), F.col("markdown").alias("text"))
    return one.unionByName(two).where("text is not null and text <> ''")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and items with placeholders, filler, or nothing but a notice."""
    return residue(records(spark, sf_dir)).select("tab", "rec_id").distinct()


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by table and kind of residue."""
    return residue(records(spark, sf_dir)).groupBy("tab", "kinds").agg(F.count("*").alias("n"))


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds}
