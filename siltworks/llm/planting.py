"""Documents with planted markup, for training and testing the labeller of ``markup``.

Lines of clean text are wrapped in constructs of HTML, Markdown, wiki text and LaTeX, so the
labels are known from the planting and not from any recognising pattern. Beside them stand
lines that only look like markup: prices, comparisons, arithmetic, identifiers, paths, menus,
bylines, placeholders, and wrongly decoded text.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

#: A planted line, the kinds it carries, its role.
Line = tuple[str, frozenset, str]
NONE, HTML, MARKDOWN, WIKI, LATEX = (frozenset(x) for x in ((), ("html",), ("markdown",), ("wiki",), ("latex",)))


class Planter:
    def __init__(self, clean: list[str], seed: int = 1):
        self.r, self.clean = random.Random(seed), clean

    def line(self) -> str:
        return self.r.choice(self.clean)

    def words(self, least: int = 1, most: int = 4) -> str:
        ws = self.line().rstrip(".!?…").split()
        n = self.r.randint(least, most)
        a = self.r.randrange(max(1, len(ws) - n))
        return " ".join(ws[a : a + n]).strip(",;:") or "word"

    def word(self) -> str:
        return self.words(1, 1).strip("“”\"'(),.") or "word"

    def number(self) -> int:
        return self.r.choice([self.r.randint(0, 12), self.r.randint(10, 999), self.r.randint(1000, 99999)])

    def inside(self, make: Callable[[str], str], least: int = 1, most: int = 6) -> str:
        """A clean line, a part of which is wrapped; at times the whole line."""
        if self.r.random() < 0.15:
            return make(self.line())
        ws = self.line().split()
        n = min(len(ws), self.r.randint(least, most))
        a = self.r.randrange(len(ws) - n + 1)
        return " ".join([*ws[:a], make(" ".join(ws[a : a + n])), *ws[a + n :]])

    def url(self) -> str:
        return self.r.choice(["https://h.example/", "http://www.h.test/a/", "/", "/r/", "../a/", "#", "mailto:a@h.example?", "page:"]) + self.r.choice(["", self.word().lower(), str(self.number()), f"{self.number()}?q={self.word()}&p=2"])

    def code(self) -> str:
        x = self.word().lower()
        return self.r.choice([f"{x}()", f"return {x}[{self.number()}]", f"<p>{x}</p>", f"# {x}", f"let {x} = a.length;", f"    {x} = [[1, 2]]", f"if {x} < 3 && {x} > 1:", f"\\frac{{{x}}}", f"'''{x}'''", f"* {x}", f"$ {x} --{x}", f"{x}_{x} = **{x}", "{{ " + x + " }}", f"| {x} | {x} |"])

    # one construct: lines with their labels
    def html(self) -> list[Line]:
        r, t = self.r, self.line
        tag = r.choice(["p", "div", "span", "b", "strong", "em", "i", "u", "h1", "h2", "h3", "section", "center", "small", "font", "blockquote", "mark", "sub", "sup", "del", "ins", "kbd", "td", "dd", "label", "figcaption", "nav", "footer", "article"])
        if r.random() < 0.3:
            tag = tag.upper()
        attr = r.choice(["", "", "", f' class="{self.word()}"', f" id='{self.word()}-{self.number()}'", f' style="color: {self.word()}"', f" title={self.word()}", f" data-x='{self.number()}'"])
        k = r.randrange(13)
        if k < 4:
            role = "heading" if tag.lower() in ("h1", "h2", "h3") else "quote" if tag.lower() == "blockquote" else "table" if tag.lower() == "td" else "text"
            whole = f"<{tag}{attr}>{t()}</{tag}>" if r.random() < 0.6 else self.inside(lambda x: f"<{tag}{attr}>{x}</{tag}>")
            return [(whole if role == "text" else f"<{tag}{attr}>{self.words()}</{tag}>", HTML, role)]
        if k == 4:
            return [(t() + f"<{r.choice(['br', 'br/', 'br /', 'BR', 'hr', 'wbr'])}>" + r.choice(["", t()]), HTML, "text")]
        if k == 5:
            return [(self.inside(lambda x: f'<a href="{self.url()}"{attr}>{x}</a>'), HTML, "text")]
        if k == 6:
            return [(self.inside(lambda x: x + r.choice(["&nbsp;", "&amp;", "&lt;", "&copy;", "&mdash;", "&#8217;", "&#xe9;", "&eacute;", "&hellip;", "&quot;"]) + self.word()), HTML, "text")]
        if k == 7:
            items = [t() for _ in range(r.randint(1, 4))]
            if r.random() < 0.4:
                return [("".join(f"<li>{x}" + r.choice(["", "</li>", "\t"]) for x in items), HTML, "list")]
            close = r.choice(["", "</li>"])
            return [("<ul>", HTML, "list"), *((f"<li>{x}{close}", HTML, "list") for x in items), ("</ul>", HTML, "list")]
        if k == 8:
            return [(f"<table{attr}>" + "".join(f"<tr><td>{self.words()}</td><td>{self.number()}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>", HTML, "table")]
        if k == 9:
            return [(f"<!-- {self.words(1, 6)} -->" + r.choice(["", t()]), HTML, "text")]
        if k == 10:
            return [(f'<img src="{self.url()}" alt="{self.words()}"{r.choice([" /", "/", ""])}>' + r.choice(["", " " + t()]), HTML, "text")]
        if k == 11:
            lines = [self.code() for _ in range(r.randint(1, 4))]
            pre = r.choice([("<pre>", "</pre>"), ("<pre><code>", "</code></pre>")])
            return [(pre[0] + lines[0] + (pre[1] if len(lines) == 1 else ""), HTML, "code"), *((x, NONE, "code") for x in lines[1:-1]), *([(lines[-1] + pre[1], HTML, "code")] if len(lines) > 1 else [])]
        return [(self.inside(lambda x: f"<code>{self.code()}</code>"), HTML, "text")]

    def markdown(self) -> list[Line]:
        r, t = self.r, self.line
        k = r.randrange(20)
        if k < 2:
            return [(r.choice(["", "", " "]) + "#" * r.randint(1, 6) + " " + self.words(1, 8) + r.choice(["", "", " #"]), MARKDOWN, "heading")]
        if k == 2:
            mark = r.choice(["- ", "* ", "+ ", "  - ", "- [ ] ", "- [x] "])
            return [(mark + t(), MARKDOWN, "list") for _ in range(r.randint(1, 4))]
        if k == 3:
            end = r.choice([". ", ") "])
            return [(f"{i + 1}{end}{t()}", MARKDOWN, "list") for i in range(r.randint(1, 4))]
        if k == 4:
            mark = r.choice(["**", "**", "__"])
            return [(self.inside(lambda x: mark + x + mark), MARKDOWN, "text")]
        if k == 5:
            mark = r.choice(["*", "*", "_", "***"])
            return [(self.inside(lambda x: mark + x + mark), MARKDOWN, "text")]
        if k == 6:
            title = r.choice(["", "", f' "{self.words()}"'])
            return [(self.inside(lambda x: f"[{x}]({self.url()}{title})"), MARKDOWN, "text")]
        if k == 7:
            return [(f"![{r.choice(['', self.words()])}]({self.url()})" + r.choice(["", " " + t()]), MARKDOWN, "text")]
        if k == 8:
            return [(r.choice(["> ", ">", "> > "]) + t(), MARKDOWN, "quote") for _ in range(r.randint(1, 2))]
        if k == 9:
            fence = r.choice(["```", "```", "~~~", "````"])
            return [(fence + r.choice(["", "python", "json", "sh"]), MARKDOWN, "code"), *((self.code(), NONE, "code") for _ in range(r.randint(1, 4))), (fence, MARKDOWN, "code")]
        if k == 10:
            return [(self.inside(lambda x: f"`{self.code().strip()}`"), MARKDOWN, "text")]
        if k == 11:
            n = r.randint(2, 4)
            row = lambda: ("| " + " | ".join(r.choice([self.words(1, 3), str(self.number())]) for _ in range(n)) + " |", MARKDOWN, "table")
            rule = r.choice(["---", ":--", "----", ":-:"])
            return [row(), ("|" + f"{r.choice(['', ' '])}{rule}{r.choice(['', ' '])}|" * n, MARKDOWN, "table"), *(row() for _ in range(r.randint(1, 3)))]
        if k == 12:
            return [(self.inside(lambda x: f"~~{x}~~"), MARKDOWN, "text")]
        if k == 13:
            return [(self.words(2, 7), MARKDOWN, "heading"), (r.choice(["=====", "-----", "==========", "------------"]), MARKDOWN, "heading")]
        if k == 14:
            return [(self.inside(lambda x: f"[{x}][{r.choice(['', self.word(), str(r.randint(1, 9))])}]"), MARKDOWN, "text"), (f"[{self.word()}]: https://h.example/{self.word()}", MARKDOWN, "text")]
        if k == 15:
            return [(self.inside(lambda x: f"<https://h.example/{self.word()}>"), MARKDOWN, "text")]
        if k == 16:
            return [(r.choice(["---", "***", "* * *", "- - -", "___"]), MARKDOWN, "text")]
        if k == 17:
            sep = r.choice([" | ", " · ", "  "])
            return [(sep.join(f"[{self.words(1, 2)}](/{i})" for i in range(r.randint(2, 6))), MARKDOWN, "text")]
        if k == 18:
            mark = r.choice(["**", "*"])
            return [(mark + self.chrome() + mark, MARKDOWN, "text")]
        return [(self.inside(lambda x: f"**[{x}]({self.url()})**"), MARKDOWN, "text")]

    def wiki(self) -> list[Line]:
        r, t = self.r, self.line
        k = r.randrange(12)
        if k == 0:
            mark = "=" * r.randint(2, 5)
            gap = r.choice([" ", " ", ""])
            return [(f"{mark}{gap}{self.words(1, 7)}{gap}{mark}", WIKI, "heading")]
        if k < 4:
            make = r.choice([lambda x: f"[[{x}]]", lambda x: f"[[{self.words()}|{x}]]", lambda x: f"[[{r.choice(['Category', 'Kategorie', 'Catégorie', 'Categoría'])}:{x}]]", lambda x: f"[[{r.choice(['File', 'Image', 'Datei', 'Fichier'])}:{self.word()}.png|thumb|{x}]]"])
            return [(make(self.words()) if r.random() < 0.25 else self.inside(make), WIKI, "text")]
        if k == 4:
            mark = r.choice(["'''", "''", "'''''"])
            return [(self.inside(lambda x: mark + x + mark), WIKI, "text")]
        if k == 5:
            cells = lambda: " || ".join(r.choice([self.words(), str(self.number())]) for _ in range(r.randint(2, 4)))
            head = r.choice(["{| class=\"wikitable\"", "{|", "{| border=1", "{| style=\"width: 9%\""])
            if r.random() < 0.5:
                return [(f"{head} |- | {cells()} |- | {cells()} |" + "}", WIKI, "table")]
            return [(head, WIKI, "table"), ("|-", WIKI, "table"), (f"| {cells()}", WIKI, "table"), ("|-", WIKI, "table"), (f"! {cells()}".replace("||", "!!"), WIKI, "table"), ("|}", WIKI, "table")]
        if k == 6:
            return [(self.inside(lambda x: f"[https://h.example/{self.number()} {x}]"), WIKI, "text")]
        if k == 7:
            return [(r.choice([t() + " ~~~~", t() + " --~~~", t() + " ~~~~~"]), WIKI, "text")]
        if k == 8:
            name = r.choice(["Infobox", "Cite web", "Main", "Quote", "Lang", self.words(1, 2).capitalize()])
            many = r.random()
            if many < 0.4:
                return [("{{" + f"{name} {self.word()}", WIKI, "text"), *((f"| {self.word().lower()} = {self.words()}", WIKI, "text") for _ in range(r.randint(1, 3))), ("}}", WIKI, "text")]
            return [(self.inside(lambda x: "{{" + f"{name}|{x}" + r.choice(["", f"|date={self.number()}"]) + "}}"), WIKI, "text")]
        if k == 9:
            return [(t() + f"<ref>{self.words(2, 6)}</ref>", WIKI | HTML, "text")]
        if k == 10:
            return [(r.choice(["; ", ": ", ":: ", "** ", "## ", ":* ", "#: "]) + f"[[{self.words()}]] {t()}", WIKI, "list") for _ in range(r.randint(1, 3))]
        return [(f"; {self.words()} : {t()}", WIKI, "list") for _ in range(r.randint(1, 3))]

    def formula(self) -> str:
        r, x = self.r, self.r.choice("abcdefghijknmpqrstuvwxyzEFTV")
        y = r.choice("abcmnxyz")
        return r.choice([f"{x}_{{{self.number()}}}", f"{x}^2", f"\\frac{{{self.number()}}}{{{y}}}", f"\\sum_{{{x}=0}}^{{{self.number()}}} {y}_{x}", f"{x} = {self.number()} \\cdot {y}", f"\\int_0^1 {x}", f"\\alpha + \\beta_{x}", f"{x}_{{{self.word()}}} \\leq {self.number()}", f"\\sqrt{{{x}}}", f"\\mathbf{{{x}}}", f"{x} \\in \\mathbb{{R}}"])

    def latex(self) -> list[Line]:
        r, t = self.r, self.line
        k = r.randrange(11)
        if k < 2:
            cmd = r.choice(["textbf", "emph", "textit", "texttt", "underline", "footnote", "cite", "ref", "label", "citep", "url", "mbox", "textsc"])
            arg = (lambda x: f"{self.word().lower()}:{self.word().lower()}{self.number()}") if cmd in ("cite", "ref", "label", "citep") else (lambda x: x)
            return [(self.inside(lambda x: f"\\{cmd}{{{arg(x)}}}"), LATEX, "text")]
        if k == 2:
            return [(f"\\{r.choice(['section', 'subsection', 'chapter', 'subsubsection', 'section*', 'paragraph'])}{{{self.words(1, 7)}}}", LATEX, "heading")]
        if k == 3:
            env = r.choice(["equation", "align", "equation*", "gather"])
            if r.random() < 0.5:
                return [(f"\\begin{{{env}}} {self.formula()} \\end{{{env}}}" + r.choice(["", " " + t()]), LATEX, "formula")]
            return [(f"\\begin{{{env}}}", LATEX, "formula"), ("  " + self.formula() + " \\cdot 2", LATEX, "formula"), (f"\\end{{{env}}}", LATEX, "formula")]
        if k == 4:
            env = r.choice(["itemize", "enumerate"])
            if r.random() < 0.5:
                return [(f"\\begin{{{env}}} " + " ".join(f"\\item {t()}" for _ in range(r.randint(1, 3))) + f" \\end{{{env}}}", LATEX, "list")]
            return [(f"\\begin{{{env}}}", LATEX, "list"), *((f"\\item {t()}", LATEX, "list") for _ in range(r.randint(1, 3))), (f"\\end{{{env}}}", LATEX, "list")]
        if k < 7:
            one = r.random()
            if one < 0.25:
                return [(self.inside(lambda x: f"${r.choice('abcnxyzNT')}{r.choice(['', '+1', ' = ' + str(self.number()), ' < y', '(t)'])}$"), LATEX, "text")]
            return [(self.inside(lambda x: f"${self.formula()}$"), LATEX, "text")]
        if k == 7:
            return [(f"$${self.formula()}$$" + r.choice(["", " " + t()]), LATEX, "formula")]
        if k == 8:
            pair = r.choice([("\\(", "\\)"), ("\\[", "\\]")])
            return [(self.inside(lambda x: pair[0] + self.formula() + pair[1]), LATEX, "text")]
        if k == 9:
            return [(f"\\{r.choice(['documentclass', 'usepackage', 'title', 'author', 'bibliography', 'input'])}{r.choice(['', '[11pt]'])}{{{self.word().lower()}}}", LATEX, "text")]
        return [(f"\\begin{{tabular}}{{ll}} {self.word()} & {self.number()} \\\\ {self.word()} & {self.number()} \\\\ \\end{{tabular}}", LATEX, "table")]

    def chrome(self) -> str:
        r, w = self.r, self.words
        date = r.choice([f"{r.randint(1, 28)} {w(1, 1)} 20{r.randint(10, 29)}", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 29)}"])
        return r.choice([f"© 20{r.randint(10, 29)} {w(1, 2)}. {w(2, 4)}.", f"{w(2, 3)} | {date} | {self.number()} min", f"{w(1, 1)} {w(2, 2)}, {date}", " | ".join(w(1, 2) for _ in range(r.randint(2, 6))), " · ".join(w(1, 2) for _ in range(r.randint(2, 6))), "  ".join(w(1, 2) for _ in range(r.randint(2, 6))), f"{w(1, 3)} ({self.number()})", f"{w(1, 4)} »", f"» {w(1, 4)}", f"{self.number()} {w(1, 1)}", f"{w(1, 3)} > {w(1, 2)} > {w(1, 2)}"])

    def plain(self) -> list[Line]:
        """Lines that carry nothing, however they look."""
        r, n, w = self.r, self.number, self.word
        k = r.random()
        if k < 0.42:
            return [(self.line(), NONE, "text")]
        if k < 0.62:
            return [(self.chrome(), NONE, "text")]
        if k < 0.7:
            return [(self._garbled(self.line()), NONE, "text")]
        x, y = w().lower(), w().lower()
        money = r.choice("$$$€£")
        look = r.choice(
            [
                lambda: f"{money}{n()} {x} {money}{n()}", lambda: f"{money}{n()}.{r.randint(10, 99)}", lambda: f"{money}{n()}-{money}{n()}", lambda: f"US${n()} {y} {money}{n()}k,",
                lambda: f"{x} < {y} {w()} {y} > {x}", lambda: f"{x} <= {n()}", lambda: f"{n()} > {n()}", lambda: f"{x} <3", lambda: f"a<b, b>c",
                lambda: f"{n()} * {n()} * {n()}", lambda: f"{n()}*{n()}", lambda: f"{x} * {y}", lambda: f"{n()} + {n()} - {n()} = {n()}", lambda: f"x = {n()} / {n()}", lambda: f"2^{n()}", lambda: f"{n()} ± {r.randint(1, 9)} %",
                lambda: f"{x}_{y}_{w()}", lambda: f"_{x}", lambda: f"{x}_", lambda: f"__{x}__.py", lambda: f"{x.upper()}_{y.upper()}", lambda: f"{x}*", lambda: f"*{x}", lambda: f"{x}**{n()}", lambda: f"#{n()}", lambda: f"#{x}", lambda: f"C#", lambda: f"@{x}",
                lambda: f"C:\\{x}\\new", lambda: f"D:\\{x}\\{y}.txt", lambda: f"\\\\{x}\\{y}", lambda: f"/usr/{x}/{y}", lambda: f"~/{x}/.{y}", lambda: f"~{n()}", lambda: f"--{x}={n()}", lambda: f"-{x[:1]}",
                lambda: f"{x}[{n()}][{n()}]", lambda: f"{x}[{n()}] = {n()}", lambda: f"[{n()}]", lambda: f"[{x}]", lambda: f"[...]", lambda: f"({x})[{y}]", lambda: f"{{{x}}}", lambda: "{{ " + x + " }}", lambda: "{{" + x + "}}", lambda: "${" + x + "}", lambda: f"%{x.upper()}%", lambda: "{" + str(r.randint(0, 3)) + "}", lambda: "{% if " + x + " %}", lambda: f"<{x} {y}", lambda: f"[[{n()}, {n()}", lambda: "{{#if " + x + "}}", lambda: f"[YOUR {x.upper()}]", lambda: f"«{x}_{y}»", lambda: f"<%= {x} %>",
                lambda: f"https://h.example/{x}_{y}?a={n()}&b={n()}", lambda: f"AT&T", lambda: f"{x} & {y}", lambda: f"R&D;", lambda: f"{x}&{y}", lambda: f"it's 'so' {y}", lambda: f"the ’{x}’", lambda: f"'{x}'", lambda: f"rock 'n' roll", lambda: f"5'11''", lambda: f"{x} -- {y}", lambda: f"{x} == {y}", lambda: f"{x} = {y}", lambda: f"{x} | {y}", lambda: f"{x}|{y}", lambda: f"`{x}", lambda: f"{x} ~ {y}", lambda: f"{x} -> {y}", lambda: f":-)", lambda: f"{x}: {y}", lambda: f"{n()}:{r.randint(10, 59)}", lambda: f"{n()}) {x}", lambda: f"100 % {x}",
            ]
        )
        ws = self.line().split()
        a = r.randint(1, max(1, len(ws) - 1))
        second = look() if r.random() < 0.3 else ""
        return [(" ".join([*ws[:a], look(), *ws[a:], second]).strip(), NONE, "text")]

    def _garbled(self, text: str) -> str:
        mark = self.r.choice(["é", "’", "ä", "—", "д", "€"])
        text = text.replace(" ", f" {mark}", 2)
        way = self.r.randrange(4)
        if way == 0:
            return text.encode("ascii", "replace").decode().replace("?", "\ufffd")
        return text.encode().decode(["cp1252", "mac_roman", "cp850"][way - 1], "replace")

    def document(self) -> list[Line]:
        r = self.r
        kinds = [k for k, p in ((self.html, 0.35), (self.markdown, 0.55), (self.wiki, 0.3), (self.latex, 0.3)) if r.random() < p]
        density = r.choice([0.08, 0.2, 0.5])
        out: list[Line] = []
        for _ in range(r.choice([1, 3, 8, 14, 22])):
            out += r.choice(kinds)() if kinds and r.random() < density else self.plain()
        return out


def documents(clean: list[str], count: int, seed: int) -> Iterator[list[Line]]:
    p = Planter(clean, seed)
    for _ in range(count):
        yield p.document()
