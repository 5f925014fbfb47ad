"""Fixed values of the data model: closed vocabularies, patterns and tables that results depend on."""

# Anchors of the backbone, in order.
ANCHORS = ("Asset", "Component", "Signal", "State", "Fault", "Seal", "Connector", "Sensor", "Controller", "Coolant", "Actuator", "Power", "Housing", "Fastener", "Media")
BASE_ANCHORS = ANCHORS[:5]
HYPERNYMS = ANCHORS[5:]
STRUCTURAL_ANCHORS = ("Asset", "Component", *HYPERNYMS)

# Patterns of step phases, first match wins.
PHASES = (
    ("verify", "verify|verifies|verified|verifying|confirm|confirms|confirmed|confirming|validate|validates|validated|validating|test|tests|tested|testing|prove|proves|proved|proving|monitor|monitors|monitored|monitoring|circulate|circulates|circulated|circulating|pressurize|pressurizes|pressurized|pressurizing"),
    ("observe", "record|records|observe|observes|inspect|inspects|inspection|measure|measures|capture|captures|note|notes|check|checks|review|reviews|examine|examines|identify|identifies|trace|traces"),
    ("diagnose", "diagnose|diagnoses|diagnosed|diagnosing|analyze|analyzes|analyzed|analyzing|compare|compares|compared|comparing|evaluate|evaluates|evaluated|evaluating|assess|assesses|assessed|assessing|determine|determines|determined|determining"),
    ("repair", "repair|repairs|replace|replaces|replacement|reseat|reseats|reset|resets|correct|corrects|refit|refits|install|installs|renew|renews|restore|restores|torque|torques|tighten|tightens|lubricate|lubricates|adjust|adjusts"),
)

# Words that hint at a type, for labels without one, in order of listing.
HINT_WORDS = (
    ("Fault", "fault|failure|crack|distortion|leak|leakage|anomaly|defect"),
    ("Signal", "level|color|wetness|wetting|path|result|height|depth|twist|load|seepage|reading|signal|telemetry"),
    ("State", "state|condition|boundary|dry|wet"),
    ("Component", "module|connector|hose|bracket|clip|plate|bead|window|land|branch|section|interface|end|neck|seat|shell|coupler|component|sensor|pack"),
    ("Asset", "pack|vehicle|machine|line|cabinet|station|platform|equipment|asset"),
)

# Words by which a rule chooses an anchor, first match wins.
ANCHOR_WORDS = (
    ("Fault", "fault|failure|defect|damage|crack|cracked|distortion|corrosion|misalignment|deformation|break|broken|fracture|short-stroke|side-load root cause"),
    ("Signal", "signal|reading|telemetry|warning|alarm|result|level|color|path|boundary|wetting|wetness|seepage|residue|height|depth|angle|offset|load|witness|mark|wear|whitening|temperature|pressure|vibration|odor|measurement"),
    ("State", "state|status|condition|mode|open|opened|closed|latched|seated|flush|dry|wet|supported|under circulation|after shutdown"),
    ("Component", "component|module|connector|hose|clip|bracket|manifold|fitting|sensor|seal|o-ring|terminal|stud|lug|nut|washer|tube|bead|window|rail|cover|shell|boot|cable|contact|valve|pump|fan|board|controller|seat|land|ear|hook|pin"),
    ("Asset", "asset|vehicle|machine|line|cabinet|platform|station|equipment|system|pack|module pack"),
)

# Patterns of rejected labels.
PERSON_TITLE = r"(?i)^(dr|mr|mrs|ms|prof)\.?\s+"
PERSON_NAME = r"^[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){1,3}$"
PERSON_ROLE = "engineer|technician|operator|inspector|analyst|doctor|specialist|reviewer|approver"
DOCUMENT_WORDS = "document|report|manual|ticket|work order|sop|procedure|case document|service report"
STEP_LABEL = r"(?i)(^|:)T\d+(?![A-Za-z0-9_])"
PLACEHOLDER = r"(?i)^(failure|fault|problem|issue|identified leak point|suspect joint|known-good reference)$"

# Patterns of relations that are dropped.
CONTEXTUAL_HEAD = "branch|path|condition|state|section|geometry|position|circuit|loop|face|surface|interface|cavity|pocket|edge"
LOW_VALUE_TAIL = "access panels?|shield|path|angle|offset|clearance|face|surface|interface|cavity|pocket|edge"
GENERIC_TARGET = r"(?i)^(root cause|underlying issue|generic fault)$"
RESULT_HEAD = r"(static|dynamic|pressure|proof|test|verification)\s+(?:hold\s+)?results?"
SIDE_LOAD_OBSERVATION = "witness marks?|witness pattern|side load|off-axis|preload|routing"
LOW_VALUE_ENDPOINTS = ("dry", "fully latched", "naturally supported", "stable")

# Plural forms.
IRREGULAR_PLURALS = {"indices": "index", "axes": "axis", "vertices": "vertex", "analyses": "analysis", "diagnoses": "diagnosis"}
KEPT_PLURALS = ("busbar edges", "busbar edge")

# Weights of relation families for anchors, added to a rank score and cut at 0.20 either way.
FAMILY_WEIGHTS = {
    "structural": {"Asset": 0.15, "Component": 0.15, "Signal": -0.10, "Fault": -0.10},
    "communication": {"Signal": 0.10, "State": 0.10, "Fault": 0.10, "Asset": -0.15},
    "propagation": {"Fault": 0.10, "Signal": 0.10, "State": 0.10, "Component": 0.10},
    "lifecycle": {"State": 0.10, "Fault": 0.10, "Component": 0.10, "Asset": 0.10},
}

# Anchors that a family can attach to.
FAMILY_ANCHORS = {
    "task_dependency": ("Task", "Signal", "State", "Fault", "Asset", "Component"),
    "communication": ("Component", "Signal", "State", "Fault"),
    "propagation": ("Fault", "Signal", "State", "Component"),
    "structural": ("Asset", "Component"),
    "lifecycle": ("Asset", "Component", "Fault", "State"),
}

# Types allowed at either end of a family's relations (head, tail).
TYPE_CONSTRAINTS = {
    "propagation": (("Fault", "Signal", "State", "Component"), ("Fault", "Signal", "State")),
    "structural": (STRUCTURAL_ANCHORS, STRUCTURAL_ANCHORS),
    "task_dependency": (("Task", *HYPERNYMS), ("Task", "Signal", "Fault", "State", *STRUCTURAL_ANCHORS)),
    "communication": (("Component", "Signal", "State"), ("Signal", "State", "Component", "Asset", "Fault")),
    "lifecycle": (("Asset", "Component", "Fault", "State"), ("State",)),
}

# Lifecycle events that edge labels stand for.
LIFECYCLE_EVENTS = {"triggers": "creation", "supersedes": "replacement", "deprecates": "deprecation", "replaces": "replacement", "causes": "fault_occurrence", "maintains": "maintenance", "repairs": "maintenance", "updates": "update", "upgrades": "update"}

# Words that name an action of a step.
ACTION_WORDS = {
    "record": "record",
    "records": "record",
    "capture": "record",
    "captures": "record",
    "document": "record",
    "documents": "record",
    "note": "record",
    "notes": "record",
    "log": "record",
    "logs": "record",
    "inspect": "inspect",
    "inspects": "inspect",
    "inspection": "inspect",
    "observe": "inspect",
    "observes": "inspect",
    "check": "inspect",
    "checks": "inspect",
    "review": "inspect",
    "reviews": "inspect",
    "watch": "inspect",
    "watches": "inspect",
    "examine": "inspect",
    "examines": "inspect",
    "identify": "inspect",
    "identifies": "inspect",
    "trace": "inspect",
    "traces": "inspect",
    "measure": "measure",
    "measures": "measure",
    "measurement": "measure",
    "gauge": "measure",
    "gauges": "measure",
    "quantify": "measure",
    "quantifies": "measure",
    "expose": "expose",
    "exposes": "expose",
    "exposure": "expose",
    "open": "expose",
    "opens": "expose",
    "access": "expose",
    "accesses": "expose",
    "uncover": "expose",
    "uncovers": "expose",
    "isolate": "expose",
    "isolates": "expose",
    "safe": "expose",
    "lift": "expose",
    "compare": "compare",
    "compares": "compare",
    "comparison": "compare",
    "compares with": "compare",
    "align": "compare",
    "aligns": "compare",
    "match": "compare",
    "matches": "compare",
    "repair": "repair",
    "repairs": "repair",
    "replacement": "repair",
    "replace": "repair",
    "replaces": "repair",
    "reseat": "repair",
    "reseats": "repair",
    "reset": "repair",
    "resets": "repair",
    "correct": "repair",
    "corrects": "repair",
    "refit": "repair",
    "refits": "repair",
    "install": "repair",
    "installs": "repair",
    "installs on": "repair",
    "renew": "repair",
    "renews": "repair",
    "restore": "repair",
    "restores": "repair",
    "torque": "repair",
    "torques": "repair",
    "tighten": "repair",
    "tightens": "repair",
    "lubricate": "repair",
    "lubricates": "repair",
    "verify": "verify",
    "verifies": "verify",
    "verification": "verify",
    "validation": "verify",
    "confirm": "verify",
    "confirms": "verify",
    "validate": "verify",
    "validates": "verify",
    "prove": "verify",
    "proves": "verify",
    "test": "verify",
    "tests": "verify",
    "pressure-test": "verify",
    "pressure-tests": "verify",
    "circulate": "verify",
    "circulates": "verify",
    "monitor": "verify",
    "monitors": "verify",
    "release": "verify",
    "remove": "remove",
    "removes": "remove",
    "removal": "remove",
    "detach": "remove",
    "detaches": "remove",
}

# Relation labels that name no action.
WEAK_RELATIONS = ("allows", "allow", "holds", "hold", "keeps", "keep", "leaves", "leave", "names", "name", "marks", "mark", "performed on", "pays attention to", "requires", "require", "runs", "run", "targets", "target")

# Where a step's summary begins and ends.
SUMMARY_PREFIX = r"(?i)^(?:for|on|at)\s+[^,]+,\s*"
SUMMARY_ENDS = (".", ";", ",", " while ", " because ", " so ", " then ", " before ", " after ")
GENERIC_CONTEXT = "branch|path|history|context|process|cycle"

# How well an action's target shows by its type (high, medium types), and why other targets are hidden.
ACTION_TARGETS = {
    "record": (("Signal", "State", "Fault"), (), "record_requires_signal_like_target"),
    "inspect": (("Signal", "Component", "State", "Fault"), (), "inspect_requires_grounded_target"),
    "measure": (("Signal", "Component", "State"), (), "measure_requires_grounded_target"),
    "compare": ((), ("Signal", "Component", "State"), "compare_requires_grounded_target"),
    "expose": (("Component",), (), "expose_requires_component_target"),
    "remove": (("Component",), (), "remove_requires_component_target"),
    "repair": (("Component",), ("State", "Fault"), "repair_requires_component_target"),
    "verify": (("State", "Fault"), ("Signal", "Component"), "verify_requires_grounded_target"),
}

# What a step acts on where no single target is named.
DEFAULT_OBJECTS = {"record": "issue evidence", "inspect": "key evidence", "measure": "critical dimensions", "expose": "local assembly", "compare": "reference dimensions", "repair": "failed interface", "verify": "repair outcome", "remove": "access cover"}

# Canonical label and family of relation labels, by their key; then the keys of passive forms, whose ends are turned round.
RELATION_LABELS = {
    "contains": ("contains", "structural"),
    "hasstate": ("hasState", "lifecycle"),
    "transitionsto": ("transitionsTo", "lifecycle"),
    "indicates": ("indicates", "communication"),
    "provides": ("provides", "communication"),
    "emits": ("emits", "communication"),
    "monitors": ("monitors", "communication"),
    "requires": ("requires", "task_dependency"),
    "measures": ("measures", "task_dependency"),
    "records": ("records", "task_dependency"),
    "confirms": ("confirms", "task_dependency"),
    "observes": ("observes", "task_dependency"),
    "performs": ("performs", "task_dependency"),
    "triggers": ("triggers", "task_dependency"),
    "causes": ("causes", "propagation"),
    "comprises": ("comprises", "propagation"),
    "causedby": ("causes", "propagation"),
    "measuredby": ("measures", "task_dependency"),
    "confirmedby": ("confirms", "task_dependency"),
    "observedin": ("observes", "task_dependency"),
    "performedby": ("performs", "task_dependency"),
    "separates": ("confirms", "task_dependency"),
}
PASSIVE_LABELS = ("causedby", "measuredby", "confirmedby", "observedin", "performedby")

# Patterns of procedure texts.
ASSET_NAMES = "pack|vehicle|machine|cabinet|controller|motor|compressor|spindle|axis|drive|battery|chiller|pump"
PROCEDURE_TYPES = (("diagnosis", "diagnosis|diagnostic"), ("inspection", "inspection|inspect|review"), ("replacement", "replacement|replace|install"), ("repair", "repair|reseat|correct"), ("verification", "verification|verify|validate"))
FAULT_TYPES = "leak|seepage|corrosion|crack|overheat|misalignment|contamination|drift|drop|offset|noise|vibration|fault|failure"
DOCUMENT_HEAD = "branch|path|condition|state"
DOCUMENT_TAIL = "hose|clip|rib|panel|overmold"
MANUAL_FILE = r"(?i)^(evman|batom|batteryman|cncom|cncman|nevom)|_om_"
MANUAL_CONTENT = r"(?i)time step|o&m sample|\| t[1-9] \|"

# Fixed value: the end of what is still valid.
FAR_FUTURE = "9999-12-31T23:59:59Z"

# Labels that name one thing, and relations that name it wrongly.
SAME_TOKENS = {"inner": "internal"}
DISTINGUISHING_TOKENS = ("inlet", "outlet", "front", "rear", "left", "right", "upper", "lower", "upstream", "downstream")
LONE_ALIASES = ("retainer",)
PARENT_WORDS = "connector|coupler|joint"
PART_WORDS = "shell|retainer|o-?ring"
GENERIC_WORDS = "replacement|new|old|removed|spare|fresh"
DAMAGE_RULES = ((r"(?i)^stress whitening$", "shell|crack|cracked|shell failure"), (r"(?i)\blatch[- ]window distortion\b", "latch|ear"), (r"(?i)\bwitness marks?\b", "side load|off-axis|preload|routing"))
BROAD_CAUSES = "side load|off-axis|preload|routing issue|history"
INDICATED_HINTS = ("Signal", "State", "Fault")
