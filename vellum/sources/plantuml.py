"""PlantUML as diagrams and as Mermaid.

A line is read from left to right by a small set of tokens: names, arrows, colours, the
text after a colon.  Two constructs carry most of the language, the declaration of an element and the link
of two elements, and all kinds of diagrams share them; what else there is begins with a word that names the method which reads it.
A block is small and its lines depend on those before, so this runs as an Arrow-batched function over blocks;
finding blocks and everything about single arrows is done with column expressions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.diagrams import ARROW
from ..schemas import AST, COLORS, SCHEMA_VERSION
from ..session import small_batches

FILES = (".puml", ".plantuml", ".pu", ".wsd")
FENCED, BARE = r"(?s)```(?:plantuml|puml)\s*\n(.*?)```", r"(?s)(@startuml.*?@enduml)"

#: What a token is; blanks before it are skipped.
TOKENS = {name: re.compile(rf"\s*{pattern}") for name, pattern in {
    "word": r"(\w+)", "quoted": r'"([^"]*)"', "boxed": r"\[([^\]]+)\]", "title": r'([^"#{<]+?)(?=\s+as\s|\s*[#{<]|\s*$)', "arrow": ARROW + r"(?![-=.<>|])",
    "stereotype": r"<<\s*(\w+)\s*>>", "color": r"#(\w+)", "open": r"(\{)", "close": r"(\})", "said": r":\s*(.*)$", "comma": r"(,)", "step": r"(\+\+|--)", "rest": r"(.*?)\s*$", "end": "()$"}.items()}


def blocks(text: Column) -> Column:
    """Fenced blocks first, whatever they hold; then bare ones."""
    bare = F.regexp_extract_all(F.regexp_replace(text, FENCED, ""), F.lit(BARE), F.lit(1))
    return F.concat(F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), bare)


#: Fixed patterns: the kinds of diagrams, statements of which one must be in the text in lower case, and words that must not; the first kind that fits holds.
KINDS = (
    ("sequence", (r"participant\s", r"actor\s+\w+\s", r"\w+\s*-+>+\s*\w+\s*:"), r"(class|package) "),
    ("class", (r"\b(class|interface)\s+\w+",), None),
    ("state", (r"\[\*\] -->", "state "), None),
    ("component", ("(package|component|node|folder|cloud|database) ",), None),
    ("activity", (r":[\w\s]+;", r"(?s)start.*stop", r"(?s)stop.*start"), None),
    ("component", ("",), None))


def diagram_type(block: Column) -> Column:
    """sequence, class, state, component or activity."""
    low = F.lower(block)
    return F.coalesce(*[F.when(low.rlike("|".join(f"({p})" for p in one)) & (F.lit(True) if none is None else ~low.rlike(none)), kind) for kind, one, none in KINDS], F.lit(KINDS[-1][0]))


def kind_of(block: str) -> str:
    """diagram_type() of one text."""
    low = block.lower()
    return next(kind for kind, one, none in KINDS if any(re.search(p, low) for p in one) and not (none and re.search(none, low)))


class Line:
    """A line and how far it has been read."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def match(self, token: str) -> re.Match | None:
        found = TOKENS[token].match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def take(self, token: str) -> str | None:
        found = self.match(token)
        return found[1] if found else None

    def word(self, *expected: str) -> str | None:
        """The next word in lower case, if it is one of `expected`; any if none is given."""
        at, word = self.at, (self.take("word") or "").lower()
        if word and (not expected or word in expected):
            return word
        self.at = at
        return None

    def name(self) -> str | None:
        for token in ("quoted", "word"):
            if (found := self.take(token)) is not None:
                return found
        return None

    def color(self) -> str | None:
        return color(self.take("color"))


def color(name: str | None) -> str | None:
    """Hex digits with a `#`, or the value of a colour's name."""
    digits = (name or "").lstrip("#")
    if 3 <= len(digits) <= 8 and set(digits.lower()) <= set("0123456789abcdef"):
        return "#" + digits
    return COLORS.get(digits.lower())


def key_of(title: str) -> str:
    """The id of an element that has a title only: letters, digits and _, 25 at most, no digit first."""
    key = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in title).strip("_")[:25]
    return f"n_{key}" if not key or key[0].isdigit() else key


@dataclass
class Arrow:
    left: str
    shaft: str
    color: str | None
    head: str
    mark: str
    step: str

    @classmethod
    def of(cls, found: re.Match) -> Arrow:
        left, before, hue, after, head, mark, step = (x or "" for x in found.groups()[:7])
        return cls(left, before + after, color(hue) if hue else None, head, mark, step)

    def style(self) -> str:
        return "thick" if "==" in self.shaft else "dotted" if ".." in self.shaft else "dashed" if len(self.shaft) > 1 and set(self.shaft) == {"-"} else "solid"

    def ends(self) -> tuple[bool, bool]:
        """Whether there is a head at the start and at the end; an arrow that is lost has none at its end."""
        return self.left.startswith("<"), bool(self.head) and self.mark != "x"

    def relation(self) -> str:
        """What the heads of a class diagram mean."""
        signs, dotted = {self.left, self.head, self.mark}, ".." in self.shaft
        if signs & {"<|", "|>"}:
            return "implements" if dotted else "extends"
        for sign, meaning in (("*", "composition"), ("o", "aggregation")):
            if sign in signs:
                return meaning
        return "dependency" if dotted else "association"


@dataclass
class Declaration:
    """`title as key <<stereotype>> #color {`, of which all but the title may be missing."""

    title: str
    key: str | None
    stereotype: str
    color: str | None
    opens: bool

    @classmethod
    def read(cls, line: Line) -> Declaration | None:
        """None where the line says anything more."""
        quoted = line.take("quoted")
        title = quoted if quoted is not None else (line.take("title") or "").strip()
        key = None if quoted is not None or not re.fullmatch(r"\w+", title) else title
        if line.word("as"):
            if (other := line.take("quoted")) is not None:
                title = other  # the title comes last
            else:
                key = line.take("word")
        stereotype, tint, opens = line.take("stereotype") or "", line.color(), line.take("open") is not None
        return cls(title, key, stereotype.lower(), tint, opens) if line.match("end") else None


def statements(block: str) -> list[str]:
    """Lines without blanks, comments and @ lines."""
    text, kept = "", block
    while "/'" in kept and "'/" in kept[kept.index("/'") :]:
        before, after = kept.split("/'", 1)
        text, kept = text + before, after.split("'/", 1)[1]
    lines = (line.strip() for line in (text + kept).split("\n"))
    return [line for line in lines if line and line[0] not in "'@"]


class Diagram:
    """What a block says: nodes and groups by id, edges in order, and lines of Mermaid for sequences."""

    kind = "component"
    ends = ("boxed", "quoted", "word")

    def __init__(self):
        self.nodes: dict[str, dict] = {}
        self.groups: dict[str, dict] = {}
        self.edges: list[dict] = []
        self.lines: list[str] = []
        self.title = ""
        self.colors: dict[str, str] = {}
        self.arrow_colors: dict[str, str] = {}

    def node(self, key: str, label: str | None = None, **more) -> str:
        node = self.nodes.setdefault(key, {"label": label or key, "shape": "rectangle", "color": None, "meta": {}})
        if label:
            node["label"] = label
        node.update(more)
        return key

    def coloured(self, tint: str | None, what: str) -> None:
        if tint:
            self.colors[tint] = what

    def edge(self, source: str, target: str, label: str, arrow: Arrow, **more) -> None:
        start, end = arrow.ends()
        self.edges.append({"source": source, "target": target, "label": label.strip(), "style": arrow.style(), "start": start, "end": end, "color": arrow.color, "rel": None} | more)

    def link(self, text: str) -> bool:
        """Reads `one arrow other : label`; False if the line is no link."""
        line, names = Line(text), []
        for last in (False, True):
            name = next((taken for token in self.ends if (taken := line.take(token)) is not None), None)
            if name is None:
                return False
            names.append(name)
            if not last:
                found = line.match("arrow")
                if not found:
                    return False
        arrow = Arrow.of(found)
        arrow.step = line.take("step") or arrow.step
        said = line.take("said")
        if said is None and not line.match("end"):
            return False
        self.linked(*names, arrow, said or "")
        return True

    def read(self, block: str) -> Diagram:
        for text in statements(block):
            if self.within(text) or self.link(text):
                continue
            line = Line(text)
            word = line.word()
            reader = getattr(self, f"on_{word}", None) if word else self.other
            if reader:
                reader(line) if word is None else reader(word, line)
        return self

    def within(self, text: str) -> bool:
        """Reads a line that belongs to something open."""
        return False

    def other(self, line: Line) -> None:
        """Reads a line that begins with no word."""


class Components(Diagram):
    #: Shapes of declared elements.
    shapes = {"database": "database", "actor": "circle", "interface": "circle"}

    def __init__(self):
        super().__init__()
        self.path: list[str] = []

    def add(self, found: Declaration, shape: str = "rectangle") -> None:
        key = self.node(found.key or key_of(found.title), found.title, shape=shape, color=found.color)
        self.coloured(found.color, found.title)
        if self.path:
            self.groups[self.path[-1]]["children"].append(key)

    def declared(self, word: str, line: Line) -> None:
        found = Declaration.read(line)
        if found and found.opens:
            key = found.key or key_of(found.title)
            self.groups[key] = {"label": found.title, "children": []}
            self.path.append(key)
            self.coloured(found.color, f"{found.title} ({word})")
        elif found and word not in ("package", "folder", "frame"):
            self.add(found, self.shapes.get(word, "rectangle"))

    on_package = on_node = on_folder = on_cloud = on_rectangle = on_frame = on_component = on_database = on_actor = on_interface = declared

    def other(self, line: Line) -> None:
        if line.take("close") and self.path:
            self.path.pop()
        elif title := line.take("boxed"):
            key = line.take("word") if line.word("as") else None
            tint = line.color()
            if line.match("end"):
                self.add(Declaration(title.strip(), key, "", tint, False))

    def linked(self, one: str, other: str, arrow: Arrow, label: str) -> None:
        keys = [name if name in self.nodes else key_of(name) for name in (one, other)]
        for key, name in zip(keys, (one, other)):
            if key not in self.nodes:
                self.node(key, name)
        self.edge(*keys, label, arrow)


class Classes(Diagram):
    kind, ends = "class", ("quoted", "word")

    def __init__(self):
        super().__init__()
        self.inside: str | None = None

    def member(self, name: str, stereotype: str = "") -> str:
        return self.node(name, name, meta={"stereotype": stereotype, "members": [], "methods": []})

    def declared(self, word: str, line: Line) -> None:
        if word == "abstract":
            line.word("class")
        found = Declaration.read(line)
        if found and found.title:
            name = self.member(found.key or key_of(found.title), found.stereotype or ("" if word == "class" else word))
            self.inside = name if found.opens else None

    on_class = on_interface = on_enum = on_abstract = declared

    def within(self, text: str) -> bool:
        if self.inside is None:
            return False
        if text == "}":
            self.inside = None
        elif not set(text) <= set("-=._{"):  # else a line between compartments
            self.nodes[self.inside]["meta"]["methods" if "(" in text and ")" in text else "members"].append(text)
        return True

    def linked(self, one: str, other: str, arrow: Arrow, label: str) -> None:
        for name in (one, other):
            if name not in self.nodes:
                self.member(name)
        self.edge(one, other, label, arrow, rel=arrow.relation(), style="solid", start=False, end=True, color=None)


class States(Diagram):
    kind, ends = "state", ("boxed", "word")

    def on_state(self, word: str, line: Line) -> None:
        found = Declaration.read(line)
        if found and found.title:
            self.node(found.key or key_of(found.title), found.title)

    def linked(self, one: str, other: str, arrow: Arrow, label: str) -> None:
        ends = ["[*]" if name == "*" else name for name in (one, other)]
        for name in ends:
            if name != "[*]" and name not in self.nodes:
                self.node(name, name)
        self.edge(*ends, label, arrow, style="solid", start=False, end=True, color=None)


#: Fixed value: how a group without a kind of its own is drawn.
SHADED = "rect rgb(240, 240, 240)"


class Sequence(Diagram):
    kind, ends = "sequence", ("quoted", "word")

    def __init__(self):
        super().__init__()
        self.note: tuple[str, list[str]] | None = None
        self.calls: list[tuple[str, str]] = []
        self.depth = 0

    def say(self, *lines: str) -> None:
        self.lines += [line.rstrip() for line in lines]

    def first(self) -> str:
        return next(iter(self.nodes), "A")

    def names(self, line: Line) -> str:
        """Words with commas between them."""
        found = [line.take("word")]
        while found[-1] and line.take("comma"):
            found.append(line.take("word"))
        return ",".join(x for x in found if x)

    def within(self, text: str) -> bool:
        line = Line(text)
        if self.note:
            if line.word("endnote") or (line.word("end") and line.word("note")):
                self.say(self.note[0] + "<br/>".join(self.note[1]))
                self.note = None
            else:
                self.note[1].append(text)
            return True
        if self.depth:
            self.depth += text.count("{") - text.count("}")
            setting = line.take("word")
            if setting:
                self.coloured(line.color(), f"skinparam {setting}")
            return True
        return False

    def on_skinparam(self, word: str, line: Line) -> None:
        self.depth = line.text.count("{") - line.text.count("}")
        if not self.depth and line.take("word"):
            self.coloured(line.color(), "skinparam")

    def on_title(self, word: str, line: Line) -> None:
        self.title = line.take("rest")

    def on_autonumber(self, word: str, line: Line) -> None:
        self.say("autonumber")

    def on_box(self, word: str, line: Line) -> None:
        quoted = line.take("quoted")
        self.say(f"box {quoted if quoted is not None else (line.take('title') or '').strip()}")

    def participant(self, word: str, line: Line, made: str = "") -> None:
        found = Declaration.read(line)
        if found and found.title:
            role, key = "actor" if word == "actor" else "participant", found.key or key_of(found.title)
            self.node(key, found.title, color=found.color, meta={"role": role})
            self.coloured(found.color, found.title)
            self.say(f"{made}{role} {key} as {found.title}")

    on_participant = on_actor = on_entity = on_boundary = on_control = on_database = on_collections = on_queue = participant

    def on_create(self, word: str, line: Line) -> None:
        role = line.word("participant", "actor", "entity", "boundary", "control", "database", "collections", "queue")
        self.participant(role or "participant", line, "create ")

    def life(self, word: str, line: Line) -> None:
        if name := line.name():
            self.say(f"{word} {name}")

    on_activate = on_deactivate = on_destroy = life

    def on_return(self, word: str, line: Line) -> None:
        text = line.take("rest")
        if self.calls:
            source, target = self.calls.pop()
            self.say(f"{target}-->>{source}: {text}")
        else:
            self.say(f"%% return {text}")

    def on_note(self, word: str, line: Line) -> None:
        side = line.word("left", "right", "over")
        if side:
            line.word("of")
            whom = self.names(line) or self.first()
            line.take("color")
            head = f"Note {side if side == 'over' else side + ' of'} {whom}: "
            text = line.take("said")
            if text is None:
                self.note = (head, [])
            else:
                self.say(head + text)

    on_hnote = on_rnote = on_note

    def on_ref(self, word: str, line: Line) -> None:
        if line.word("over"):
            whom = self.names(line)
            self.say(SHADED, f"    Note over {whom}: ref: {line.take('said') or ''}", "end")

    def fragment(self, word: str, line: Line) -> None:
        self.say(f"{word} {line.take('rest')}")

    on_alt = on_opt = on_loop = on_break = on_critical = on_par = on_else = on_and = fragment

    def on_group(self, word: str, line: Line) -> None:
        self.say(SHADED)
        if text := line.take("rest"):
            self.say(f"    Note over {self.first()}: {text}")

    def on_end(self, word: str, line: Line) -> None:
        self.say("end")

    on_endbox = on_end

    def other(self, line: Line) -> None:
        text = line.text
        if text.startswith("==") and text.endswith("=="):
            self.say(f"Note over {self.first()}: --- {text.strip('= ')} ---")
        elif text.startswith("..."):
            self.say(f"Note over {self.first()}: ⏳ {text.strip('. ') or 'delay'}")

    def linked(self, one: str, other: str, arrow: Arrow, label: str) -> None:
        keys = [key_of(name) for name in (one, other)]
        for key, name in zip(keys, (one, other)):
            if key not in self.nodes:
                self.node(key, name, meta={"role": "participant"})
        if arrow.ends() == (True, False):  # an arrow to the left is a message the other way round
            keys.reverse()
            arrow = Arrow("", arrow.shaft, arrow.color, ">", arrow.mark, arrow.step)
        if arrow.color:
            self.arrow_colors[arrow.color] = label.strip() or f"{keys[0]} to {keys[1]}"
        style, lost = arrow.style(), arrow.mark == "x"
        if lost:
            sign = "--x" if style == "dashed" else "-x"
        else:
            sign = ("--" if style in ("dashed", "dotted") else "-") + (">>" if arrow.ends()[1] else ">") + {"++": "+", "--": "-"}.get(arrow.step, "")
        self.say(f"{keys[0]}{sign}{keys[1]}: {label.strip()}")
        self.calls.append((keys[0], keys[1]))
        self.edge(*keys, label, arrow)


def read(block: str, kind: str) -> Diagram:
    return {"sequence": Sequence, "class": Classes, "state": States}.get(kind, Components)().read(block)


def legend(d: Diagram) -> list[str]:
    """Comments that tell what colours and lines stand for."""
    out = [f"    %% {c}: {what}" for c, what in d.colors.items()] + [f"    %% arrows in {c}: {what}" for c, what in d.arrow_colors.items()]
    styles = list(dict.fromkeys(e["style"] for e in d.edges))
    if d.kind == "component" and len(styles) > 1:
        out += [f"    %% {style} lines: {sum(e['style'] == style for e in d.edges)}" for style in styles]
    return ["", *out] if out else []


def flow_arrow(e: dict) -> str:
    body, bare = {"dashed": ("-.-", ""), "dotted": ("-.-", ""), "thick": ("==", "=")}.get(e["style"], ("--", "-"))
    return ("<" if e["start"] else "") + body + (">" if e["end"] else "" if e["start"] else bare)


def mermaid(d: Diagram) -> str:
    """Mermaid text without a fence."""
    out = []
    if d.kind == "sequence":
        out = ["sequenceDiagram", *([f"    %% Title: {d.title}"] if d.title else []), *(f"    {x}" for x in d.lines)]
    elif d.kind == "class":
        signs = {"extends": "<|--", "implements": "<|..", "composition": "*--", "aggregation": "o--", "dependency": "<.."}
        out = ["classDiagram"]
        for key, n in d.nodes.items():
            m = n["meta"]
            out += [f"    class {key} {{", *([f"        <<{m['stereotype']}>>"] if m["stereotype"] else []), *(f"        {x}" for x in [*m["members"], *m["methods"]]), "    }"]
        out += [f"    {e['source']} {signs.get(e['rel'], '--')} {e['target']}" + (f" : {e['label']}" if e["label"] else "") for e in d.edges]
    elif d.kind == "state":
        out = ["stateDiagram-v2", *(f"    {k} : {n['label']}" for k, n in d.nodes.items() if n["label"] != k), *(f"    {e['source']} --> {e['target']}" + (f" : {e['label']}" if e["label"] else "") for e in d.edges)]
    else:
        ends = {"database": ('[("', '")]'), "circle": ('(("', '"))'), "stadium": ('(["', '"])')}
        classes = {c: f"color{i}" for i, c in enumerate(dict.fromkeys(n["color"] for n in d.nodes.values() if n["color"]))}
        out = ["flowchart TB", *(f"    classDef {name} fill:{c},stroke:{c},color:#FFFFFF" for c, name in classes.items())]

        def declared(key: str) -> str:
            n = d.nodes[key]
            a, b = ends.get(n["shape"], ('["', '"]'))
            return f"{key}{a}{n['label']}{b}" + (f":::{classes[n['color']]}" if n["color"] else "")

        placed = set()
        for g in d.groups.values():
            if g["children"]:
                out += [f'    subgraph {re.sub("[^a-zA-Z0-9_]", "_", g["label"])}["{g["label"]}"]', *(f"        {declared(k)}" for k in dict.fromkeys(g["children"])), "    end"]
                placed.update(g["children"])
        out += [f"    {declared(k)}" for k in d.nodes if k not in placed]
        out += [f"    {e['source']} {flow_arrow(e)}" + (f'|"{e["label"]}"|' if e["label"] else "") + f" {e['target']}" for e in d.edges]
    return "\n".join([*out, *legend(d)])


def tree(d: Diagram) -> dict:
    """The diagram model of schemas.AST."""
    kind = {"sequence": "sequence", "class": "class", "state": "state"}.get(d.kind, "flowchart")
    text = lambda meta: {k: "\n".join(v) if isinstance(v, list) else v for k, v in meta.items() if v}
    parent = {c: g for g, v in d.groups.items() for c in v["children"]}
    return {
        "nodes": [{"id": k, "label": n["label"], "shape": n["shape"], "x": 0.0, "y": 0.0, "width": 0.0, "height": 0.0, "fill_color": n["color"], "stroke_color": None, "font_color": None, "parent_group": parent.get(k), "confidence": 1.0, "metadata": text(n["meta"])} for k, n in d.nodes.items()],
        "edges": [{"id": f"edge_{i}", "source": e["source"], "target": e["target"], "label": e["label"], "style": e["style"], "arrow_start": e["start"], "arrow_end": e["end"], "color": e["color"], "confidence": 1.0, "metadata": {"rel_type": e["rel"]} if e["rel"] else {}} for i, e in enumerate(d.edges, 1)],
        "groups": [{"id": k, "label": g["label"], "children": list(dict.fromkeys(g["children"])), "parent_group": None, "style": "solid", "fill_color": None} for k, g in d.groups.items()],
        "diagram_type": kind, "direction": "TB", "metadata": {"source_format": "plantuml"}, "schema_version": SCHEMA_VERSION}


def convert(block: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows = []
    for text, of in zip(block, kind):
        try:
            d = read(text or "", of)
            rows.append((json.dumps(tree(d)), mermaid(d), None))
        except Exception as e:  # noqa: BLE001  one bad block is a row with an error, not a failed job
            rows.append((None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["ast", "mermaid", "error"])


def diagrams(found: DataFrame) -> DataFrame:
    """`found` (diagram_id, block) with kind, mermaid, error and the fields of schemas.AST."""
    small_batches()
    converted = F.pandas_udf(convert, "ast string, mermaid string, error string")
    rows = found.withColumn("kind", diagram_type(F.col("block"))).withColumn("c", converted("block", "kind"))
    return rows.withColumn("a", F.from_json("c.ast", AST)).select(*found.columns, "kind", F.col("c.mermaid").alias("mermaid"), F.col("c.error").alias("error"), "a.*")


def rewritten(pages: DataFrame, column: str = "markdown") -> DataFrame:
    """`pages` with PlantUML blocks as Mermaid fences: fenced ones first, then bare ones; a block that fails stays."""

    def edit(text: pd.Series) -> pd.Series:
        def fence(m: re.Match) -> str:
            try:
                return f"```mermaid\n{mermaid(read(m[1], kind_of(m[1])))}\n```"
            except Exception:  # noqa: BLE001
                return m[0]

        def one(t: str) -> str:
            return re.sub(BARE, fence, re.sub(FENCED, fence, t))

        return text.map(one, na_action="ignore")

    small_batches()
    return pages.withColumn(column, F.pandas_udf(edit, "string")(column))
