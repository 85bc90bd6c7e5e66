"""Word lists, patterns and cascades that results depend on (fixed values)."""

STORE_DIR = ".stratum"

SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", STORE_DIR, "target"]
CHAT_SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", STORE_DIR, "target"]
TEXT_EXTENSIONS = [
    ".txt", ".md", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".html", ".css", ".java", ".go", ".rs", ".rb", ".sh", ".csv", ".sql", ".toml",
]
CHAT_EXTENSIONS = [".txt", ".md", ".json", ".jsonl"]
SKIP_FILES = ["stratum.yaml", "stratum.yml", "rooms.yaml", "rooms.yml", ".gitignore", "package-lock.json"]
GENERIC_NAMES = ["project", "projects", "repo", "repos", "src", "source", "code", "app", "apps", "convos", "chat", "chats"]

#: hall of a file: (words in the room's name, words in the content, hall), first match wins
FILE_HALLS = [
    (["decision"], ["decided", "decision", "chose", "switched", "migrated", "trade-off"], "hall_facts"),
    (["preference"], ["prefer", "always", "never", "like", "hate", "favorite"], "hall_preferences"),
    (["problem"], ["fixed", "debug", "issue", "problem", "failed", "resolved", "incident"], "hall_events"),
    (["plan", "roadmap"], ["roadmap", "milestone", "deadline", "next step", "timeline", "plan"], "hall_events"),
    (["advice"], ["should", "recommend", "suggest", "advice", "better", "avoid"], "hall_advice"),
    (["architecture", "design"], ["architecture", "schema", "design", "interface", "layer"], "hall_facts"),
    ([], ["discovered", "realized", "insight", "learned", "breakthrough"], "hall_discoveries"),
]

#: hall of a chat chunk by its room
CHAT_ROOM_HALLS = {
    "decision": "hall_facts", "decisions": "hall_facts", "preference": "hall_preferences", "preferences": "hall_preferences", "milestone": "hall_events",
    "problem": "hall_events", "problems": "hall_events", "emotional": "hall_discoveries", "architecture": "hall_facts", "planning": "hall_events",
}
CHAT_TECHNICAL_HALLS = [(["error", "failed", "fix"], "hall_events"), (["decided", "architecture", "schema"], "hall_facts")]
CHAT_HALLS = [
    (["prefer", "always", "never"], "hall_preferences"), (["decided", "because", "chose"], "hall_facts"),
    (["issue", "problem", "resolved"], "hall_events"), (["learned", "realized"], "hall_discoveries"),
]

CHAT_ROOMS = {
    "technical": ["code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"],
    "architecture": ["architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer"],
    "planning": ["plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"],
    "decisions": ["decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"],
    "problems": ["problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"],
}

#: memory types with their patterns over lower-case text; earlier types win ties
MARKERS = {
    "decision": [
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b", r"\binstead of\b", r"\bbecause\b",
        r"\btrade-?off\b", r"\barchitecture\b", r"\bapproach\b", r"\bframework\b", r"\bconfigure\b",
    ],
    "preference": [
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b", r"\bi like (to|when|how)\b",
        r"\bi hate (when|how|it when)\b", r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b",
    ],
    "milestone": [
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b", r"\bfinally\b",
        r"\bdiscovered\b", r"\brealized\b", r"\bthe key (is|was|insight)\b", r"\bbuilt\b", r"\bimplemented\b", r"\bdeployed\b",
    ],
    "problem": [
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\broot cause\b", r"\bthe fix (is|was)\b",
        r"\bworkaround\b", r"\bresolved\b", r"\bpatched\b",
    ],
    "emotional": [
        r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bgrateful\b", r"\bangry\b", r"\bworried\b",
        r"i feel", r"i'm scared", r"i love you", r"i'm sorry", r"i wish", r"i miss",
    ],
}
POSITIVE = ["proud", "joy", "happy", "love", "beautiful", "amazing", "wonderful", "excited", "grateful", "breakthrough", "success", "works", "working", "solved", "fixed"]
NEGATIVE = ["bug", "error", "crash", "fail", "failed", "broken", "issue", "problem", "wrong", "stuck", "panic", "disaster"]
RESOLUTIONS = ["fixed", "solved", "resolved", "patched", "got it working", "it works", "nailed it", "figured it out", "the fix", "the solution"]

TURN_LINE = r"^(>\s|(Human|User|Q)\s*:|(Assistant|AI|A|Claude|ChatGPT)\s*:)"
CODE_LINE = (
    r"^([\$#]\s|(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s"
    r"|```|(import|from|def|class|function|const|let|var|return)\s)"
)

#: facts in text: predicate, pattern (subject, object), confidence
FACTS = [
    ("prefers", r"\b([A-Z][a-zA-Z0-9_]+)\s+prefers\s+([A-Z][a-zA-Z0-9_]+|[a-z][a-zA-Z0-9_-]+)", 0.85),
    ("uses", r"\b([A-Z][a-zA-Z0-9_]+)\s+uses\s+([A-Z][a-zA-Z0-9_]+|[a-z][a-zA-Z0-9_-]+)", 0.8),
    ("works_on", r"\b([A-Z][a-zA-Z0-9_]+)\s+works on\s+([A-Z][a-zA-Z0-9_]+)", 0.8),
    ("decided_to_use", r"\b([A-Z][a-zA-Z0-9_]+)?\s*decided to use\s+([A-Z][a-zA-Z0-9_]+|[a-z][a-zA-Z0-9_-]+)", 0.75),
]
DEFAULT_SUBJECT = "team"

CONTENT_DATES = [r"\b(20\d{2}-\d{2}-\d{2})\b", r"\b(20\d{2}/\d{2}/\d{2})\b", r"\b(20\d{2}\.\d{2}\.\d{2})\b", r"\b(20\d{2}-\d{2})\b", r"\b(20\d{2}_\d{2}_\d{2})\b"]
NAME_DATES = [r"(20\d{2}-\d{2}-\d{2})", r"(20\d{2}_\d{2}_\d{2})", r"(20\d{2}-\d{2})"]
ANCHOR = r"\b([A-Z][a-zA-Z0-9_]{2,}|[a-z]+(?:-[a-z0-9]+){1,}|[A-Z][a-zA-Z0-9]+(?:[A-Z][a-zA-Z0-9]+)+)\b"

EMOTIONS = [
    ("decided", "determ"), ("prefer", "convict"), ("worried", "anx"), ("excited", "excite"), ("frustrated", "frust"), ("confused", "confuse"), ("love", "love"),
    ("hate", "rage"), ("hope", "hope"), ("fear", "fear"), ("trust", "trust"), ("happy", "joy"), ("sad", "grief"), ("surprised", "surprise"), ("grateful", "grat"),
    ("curious", "curious"), ("wonder", "wonder"), ("anxious", "anx"), ("relieved", "relief"), ("satisf", "satis"),
]
FLAGS = [
    ("decided", "DECISION"), ("chose", "DECISION"), ("switched", "DECISION"), ("migrated", "DECISION"), ("replaced", "DECISION"), ("because", "DECISION"),
    ("founded", "ORIGIN"), ("created", "ORIGIN"), ("started", "ORIGIN"), ("launched", "ORIGIN"), ("core", "CORE"), ("fundamental", "CORE"),
    ("turning point", "PIVOT"), ("breakthrough", "PIVOT"), ("api", "TECHNICAL"), ("database", "TECHNICAL"), ("architecture", "TECHNICAL"), ("deploy", "TECHNICAL"),
    ("framework", "TECHNICAL"), ("server", "TECHNICAL"),
]
TOPIC = r"[A-Za-z][A-Za-z_-]{2,}"
STOP_WORDS = (
    "the a an is are was were be been to of in for on with at by from as and but or if that this these those it its i we you they my your our their "
    "what which who because like use using make made thing things"
).split()
CUES = "decided because instead prefer switched chose realized important key critical discovered learned solution reason breakthrough insight".split()
