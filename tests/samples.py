"""Pages and drawings that the tests parse."""

import base64
import zlib
from urllib.parse import quote

STORAGE = """<h1>Page</h1>
<ac:structured-macro ac:name="markdown"><ac:plain-text-body><![CDATA[# Raw *md*]]></ac:plain-text-body></ac:structured-macro>
<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sql</ac:parameter><ac:parameter ac:name="title">Q1</ac:parameter><ac:plain-text-body><![CDATA[select 1]]></ac:plain-text-body></ac:structured-macro>
<ac:structured-macro ac:name="mermaid-cloud"><ac:plain-text-body><![CDATA[
graph LR
  A --> B
]]></ac:plain-text-body></ac:structured-macro>
<ac:structured-macro ac:name="noformat"><ac:plain-text-body><![CDATA[  kept  ]]></ac:plain-text-body></ac:structured-macro>
<ac:structured-macro ac:name="excerpt"><ac:rich-text-body><p>short</p></ac:rich-text-body></ac:structured-macro>"""
CELLS = '<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/><mxCell id="g" value="Group" style="group" vertex="1" parent="1"/><mxCell id="a" value="A&lt;br&gt;one" style="rounded=1;fillColor=#dae8fc" vertex="1" parent="g"><mxGeometry x="10" y="20" width="80" height="40"/></mxCell><mxCell id="b" value="Store" style="shape=cylinder3" vertex="1" parent="g"><mxGeometry x="300" y="30" width="80" height="40"/></mxCell><mxCell id="e" value="uses" style="dashed=1" edge="1" source="a" target="b" parent="1"/></root></mxGraphModel>'
SVG = '<svg xmlns="http://www.w3.org/2000/svg"><rect x="0" y="0" width="100" height="50" fill="#dae8fc"/><rect x="200" y="0" width="100" height="50" rx="12" stroke="#000"/><rect x="0" y="90" width="5" height="5" fill="#000"/><text x="50" y="25">Web App</text><text x="250" y="25">API</text><line x1="100" y1="25" x2="200" y2="25" marker-end="url(#a)" stroke-dasharray="4"/><line x1="101" y1="26" x2="199" y2="26"/></svg>'
PLANTUML = [
    ("sequence", "@startuml\ntitle Login\nactor User\nparticipant \"Web App\" as W #lightblue\nUser -> W ++ : open\nalt ok\nW --> User : page\nelse bad\nW ->x User : no\nend\nnote right of W\n one\n two\nend note\nreturn done\n@enduml"),
    ("component", "@startuml\npackage \"Core\" {\n[API] as api #orange\ndatabase \"DB\" as db\n}\napi --> db : sql\napi <..> [Queue]\n@enduml"),
    ("class", "@startuml\ninterface Shape {\n+area()\n}\nclass Circle {\n-r: float\n+area()\n}\nCircle ..|> Shape\nCircle *-- Point : centre\n@enduml"),
    ("state", "@startuml\nstate \"In use\" as Busy\n[*] --> Idle\nIdle --> Busy : start\nBusy --> [*]\n@enduml"), ("activity", "@startuml\nstart\n:do it;\nstop\n@enduml"), ("empty", "")]


def compressed(xml: str) -> str:
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return base64.b64encode(packer.compress(quote(xml).encode()) + packer.flush()).decode()


DRAWIO = [("plain", CELLS), ("packed", f'<mxfile><diagram name="p">{compressed(CELLS)}</diagram></mxfile>'), ("pages", f"<mxfile><diagram>{CELLS}</diagram><diagram>{CELLS}</diagram></mxfile>"), ("bad", "garbage")]

#: page_id, storage_html, view_html
PAGES = [("p1", STORAGE, ""), ("p2", STORAGE, "<p>view only</p>"), ("p3", "<p>plain</p>", None), ("p4", None, None)]
