"""Schemas and fixed values of the governance model."""

from __future__ import annotations

NODE = "struct<id:string,label:string,shape:string,x:double,y:double,width:double,height:double,fill_color:string,stroke_color:string,font_color:string,parent_group:string,confidence:double,metadata:map<string,string>>"
EDGE = "struct<id:string,source:string,target:string,label:string,style:string,arrow_start:boolean,arrow_end:boolean,color:string,confidence:double,metadata:map<string,string>>"
GROUP = "struct<id:string,label:string,children:array<string>,parent_group:string,style:string,fill_color:string>"
AST = f"nodes array<{NODE}>, edges array<{EDGE}>, groups array<{GROUP}>, diagram_type string, direction string, metadata map<string,string>, schema_version string"
DIAGRAM = f"diagram_id string, {AST}"
FINDING = "doc_id long, rule_id string, category string, origin string, status string, evidence string, risk string"
SCHEMA_VERSION = "1.0.0"

# Domains of the diagram model.
SHAPES = ("rectangle", "stadium", "database", "diamond", "circle", "parallelogram", "hexagon")
EDGE_STYLES = ("solid", "dashed", "dotted", "thick")
DIAGRAM_TYPES = ("flowchart", "sequence", "class", "state", "er")
DIRECTIONS = ("TB", "BT", "LR", "RL")
MERMAID_TYPES = (
    "flowchart", "graph", "sequenceDiagram", "classDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "gantt", "pie",
    "gitGraph", "journey", "mindmap", "timeline", "quadrantChart", "sankey", "xychart", "block")
RESERVED = ("end", "graph", "flowchart", "subgraph", "direction", "click", "style", "classDef", "class")

# Severities in order, category weights in percent, grades.
SEVERITIES = ("critical", "high", "medium", "low")
WEIGHTS = {"patterns": 30, "standards": 30, "security": 40}
PASS_FROM, WARN_FROM = 70, 50

RULE = "rule_id string, category string, kind string, severity string, required boolean, keywords array<string>"
# The rules that ship.
SHIPPED_RULES = [
    ("PAT-001", "patterns", "rule", "high", True, ["repository", "data access", "persistence", "DAO"]),
    ("PAT-002", "patterns", "rule", "high", True, ["dependency injection", "DI", "IoC", "inject", "container"]),
    ("PAT-003", "patterns", "rule", "high", True, ["API gateway", "gateway", "entry point", "facade"]),
    ("PAT-004", "patterns", "rule", "medium", False, ["factory", "create", "builder"]),
    ("PAT-005", "patterns", "rule", "medium", False, ["circuit breaker", "resilience", "fallback", "retry"]),
    ("PAT-006", "patterns", "rule", "medium", False, ["event", "message", "queue", "pub/sub"]),
    ("ANTI-001", "patterns", "anti_pattern", "high", False, ["manager", "handler", "processor"]),
    ("STD-001", "standards", "rule", "high", True, ["v1", "v2", "version", "API version"]),
    ("STD-002", "standards", "rule", "medium", True, ["overview", "diagram", "description", "context"]),
    ("STD-003", "standards", "rule", "high", True, ["error", "exception", "handling", "retry", "fallback"]),
    ("STD-004", "standards", "rule", "medium", True, ["Service", "Controller", "Repository", "Handler"]),
    ("STD-005", "standards", "rule", "medium", True, ["health", "liveness", "readiness"]),
    ("STD-006", "standards", "rule", "medium", True, ["configuration", "config", "environment"]),
    ("STD-007", "standards", "rule", "medium", True, ["logging", "log", "monitoring", "observability"]),
    ("STD-008", "standards", "rule", "low", False, ["schema", "database", "ERD", "data model"]),
    ("SEC-001", "security", "rule", "critical", True, ["authentication", "auth", "OAuth", "JWT", "SSO"]),
    ("SEC-002", "security", "rule", "critical", True, ["authorization", "RBAC", "permission", "access control"]),
    ("SEC-003", "security", "rule", "critical", True, ["encryption", "TLS", "HTTPS", "AES", "at rest"]),
    ("SEC-004", "security", "rule", "critical", True, ["secrets", "vault", "key management"]),
    ("SEC-005", "security", "rule", "high", True, ["validation", "sanitize", "input validation"]),
    ("SEC-006", "security", "rule", "critical", True, ["parameterized", "prepared statement", "ORM"]),
    ("SEC-007", "security", "rule", "high", True, ["audit", "audit log", "security log"]),
    ("SEC-008", "security", "rule", "medium", False, ["rate limit", "throttle"]),
    ("SEC-009", "security", "rule", "medium", False, ["CORS", "cross-origin"]),
    ("VULN-001", "security", "vulnerability", "critical", False, ["password=", "secret=", "apikey=", "token="]),
]
#: Rules of our own whose words occur in invented prose, so that every grade is reached.
PROBE_RULES = [
    ("PAT-101", "patterns", "rule", "high", True, ["that", "the", "que", "die"]),
    ("PAT-102", "patterns", "rule", "high", True, ["with", "in", "de", "der"]),
    ("PAT-103", "patterns", "rule", "high", True, ["this", "and", "la", "und"]),
    ("PAT-104", "patterns", "rule", "high", True, ["from", "of", "el", "das"]),
    ("PAT-105", "patterns", "rule", "medium", False, ["ther", "les", "los", "ein"]),
    ("PAT-106", "patterns", "rule", "medium", False, ["than", "des", "del", "von"]),
    ("ANTI-101", "patterns", "anti_pattern", "high", False, ["thre", "tres"]),
    ("STD-101", "standards", "rule", "high", True, ["it", "le", "en", "ist"]),
    ("STD-102", "standards", "rule", "medium", True, ["is", "un", "se", "zu"]),
    ("STD-103", "standards", "rule", "high", True, ["to", "et", "las", "den"]),
    ("STD-104", "standards", "rule", "medium", True, ["as", "qui", "por", "mit"]),
    ("STD-105", "standards", "rule", "medium", True, ["at", "dans", "con", "im"]),
    ("STD-106", "standards", "rule", "medium", True, ["be", "pour", "para", "auf"]),
    ("STD-107", "standards", "rule", "low", False, ["by", "sur", "su", "nicht"]),
    ("SEC-101", "security", "rule", "critical", True, ["on", "par", "al", "eine"]),
    ("SEC-102", "security", "rule", "critical", True, ["or", "au", "lo", "als"]),
    ("SEC-103", "security", "rule", "critical", True, ["for", "avec", "como", "auch"]),
    ("SEC-104", "security", "rule", "high", True, ["was", "ne", "pero", "es"]),
    ("SEC-105", "security", "rule", "high", True, ["are", "pas", "sus", "an"]),
    ("SEC-106", "security", "rule", "medium", False, ["an", "on", "le", "ar"]),
    ("SEC-107", "security", "rule", "critical", True, ["he", "il", "ha", "er"]),
    ("VULN-101", "security", "vulnerability", "critical", False, ["password=", "secret=", "apikey=", "token="]),
]

# Colour names.
COLORS = {
    "red": "#FF0000", "blue": "#0000FF", "green": "#008000", "orange": "#FFA500", "yellow": "#FFFF00", "purple": "#800080",
    "pink": "#FFC0CB", "black": "#000000", "white": "#FFFFFF", "gray": "#808080", "grey": "#808080", "lightblue": "#ADD8E6",
    "darkblue": "#00008B", "lightgreen": "#90EE90", "darkgreen": "#006400", "lightgray": "#D3D3D3", "lightgrey": "#D3D3D3", "darkgray": "#A9A9A9",
    "darkgrey": "#A9A9A9", "cyan": "#00FFFF", "magenta": "#FF00FF", "brown": "#A52A2A", "navy": "#000080", "teal": "#008080",
    "maroon": "#800000", "olive": "#808000", "aqua": "#00FFFF", "coral": "#FF7F50", "salmon": "#FA8072", "gold": "#FFD700",
    "silver": "#C0C0C0", "skyblue": "#87CEEB", "tomato": "#FF6347", "wheat": "#F5DEB3", "beige": "#F5F5DC", "ivory": "#FFFFF0",
    "linen": "#FAF0E6", "crimson": "#DC143C", "indigo": "#4B0082",
}
