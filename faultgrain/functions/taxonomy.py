"""Defect categories and the rules that find them in messages."""

from __future__ import annotations

# Category, base confidence and patterns of each rule, in the order that breaks ties.
# A category's place is its label, from 0; the first ten are general, the rest are of translated code.
RULES: list[tuple[str, float, list[str]]] = [
    ("Memory Safety", 0.85, ["use after free", "use-after-free", "null pointer", "nullptr", "buffer overflow", "memory leak", "dangling pointer", "double free", "heap corruption"]),
    ("Concurrency Bugs", 0.80, ["race condition", "data race", "deadlock", "atomicity", "thread safety", "concurrent", "synchronization", "mutex", "lock contention"]),
    ("Security Vulnerabilities", 0.90, ["sql injection", "xss", "cross-site scripting", "authentication", "authorization", "security", "vulnerability", "exploit", "cve-"]),
    ("Logic Errors", 0.70, ["off by one", "off-by-one", "boundary", "incorrect logic", "wrong condition", "infinite loop"]),
    ("API Misuse", 0.75, ["api misuse", "wrong parameter", "incorrect usage", "missing error handling", "unchecked error"]),
    ("Resource Leaks", 0.80, ["resource leak", "file handle leak", "connection leak", "not closed", "forgot to close"]),
    ("Type Errors", 0.75, ["type error", "type mismatch", "casting error", "serialization", "deserialization"]),
    ("Configuration Errors", 0.70, ["configuration", "config", "environment variable", "missing env", "settings"]),
    ("Performance Issues", 0.65, ["performance", "slow", "inefficient", "n+1 query", "optimization"]),
    ("Integration Failures", 0.70, ["integration", "compatibility", "version mismatch", "breaking change", "api change"]),
    ("Operator Precedence", 0.80, ["operator precedence", "parentheses", "parse expression", "order of operations", "precedence", "expression parsing", "operator order"]),
    ("Type Annotation Gaps", 0.75, ["type annotation", "type hint", "unsupported type", "generic type", "type parameter", "annotation", "typing"]),
    ("Stdlib Mapping", 0.80, ["stdlib", "standard library", "python to rust", "library mapping", "std::", "builtin", "library conversion"]),
    ("AST Transform", 0.85, ["ast", "hir", "codegen", "transform", "syntax tree", "ast node", "tree traversal"]),
    ("Comprehension Bugs", 0.80, ["comprehension", "list comprehension", "dict comprehension", "set comprehension", "generator", "generator expression"]),
    ("Iterator Chain", 0.80, ["iterator", "into_iter", ".map(", ".filter(", ".chain(", "iterator chain", "iter method"]),
    ("Ownership/Borrow", 0.85, ["ownership", "borrow", "lifetime", "borrow checker", "move", "borrowed value", "lifetime parameter"]),
    ("Trait Bounds", 0.80, ["trait bound", "generic constraint", "where clause", "impl trait", "trait constraint", "bound"]),
]

#: Labels by the order of the taxonomy, which differs from the order of the rules for some general categories.
CATEGORIES = [
    "Memory Safety", "Concurrency Bugs", "Logic Errors", "API Misuse", "Resource Leaks", "Type Errors",
    "Configuration Errors", "Security Vulnerabilities", "Performance Issues", "Integration Failures",
    "Operator Precedence", "Type Annotation Gaps", "Stdlib Mapping", "AST Transform", "Comprehension Bugs",
    "Iterator Chain", "Ownership/Borrow", "Trait Bounds",
]

BOOST, CEILING = 0.05, 0.95

# The finer categories of messages that fix something, in the order that breaks ties.
FIX_RULES: list[tuple[str, float, list[str]]] = [
    ("ASTTransform", 0.85, ["ast", "transform", "node", "codegen", "syntax tree", "parse tree"]),
    ("TypeErrors", 0.85, ["type error", "type mismatch", "wrong type", "type annotation"]),
    ("OwnershipBorrow", 0.85, ["ownership", "borrow", "move", "lifetime", "reference"]),
    ("LifetimeAnnotation", 0.80, ["lifetime", "'a", "'static", "lifetime bound"]),
    ("TraitBounds", 0.80, ["trait bound", "where clause", "impl trait", "dyn trait"]),
    ("PatternMatching", 0.80, ["pattern", "match arm", "destructure", "if let"]),
    ("ErrorHandling", 0.80, ["error handling", "unwrap", "expect", "result", "option"]),
    ("MemorySafety", 0.85, ["null pointer", "memory leak", "buffer overflow", "use after free", "double free", "dangling"]),
    ("ConcurrencyBugs", 0.85, ["race condition", "deadlock", "mutex", "lock", "thread", "async", "concurrent"]),
    ("StdlibMapping", 0.80, ["stdlib", "standard library", "mapping", "python to rust"]),
    ("MacroHygiene", 0.80, ["macro", "hygiene", "expansion", "proc macro"]),
    ("FFIBoundary", 0.80, ["ffi", "foreign function", "c binding", "extern", "unsafe"]),
    ("BuildConfiguration", 0.75, ["build", "cargo", "feature flag", "compile", "linker"]),
    ("TestCoverage", 0.75, ["test", "coverage", "assertion", "unit test", "integration test"]),
    ("DocumentationSync", 0.70, ["doc", "documentation", "rustdoc", "comment"]),
    ("PerformanceRegression", 0.80, ["performance", "slow", "optimize", "benchmark", "regression"]),
    ("SecurityVulnerabilities", 0.90, ["security", "vulnerability", "cve", "exploit", "injection", "xss", "sql injection"]),
    ("OperatorPrecedence", 0.80, ["precedence", "operator", "parentheses", "associativity"]),
    ("TypeAnnotationGaps", 0.80, ["type annotation", "inference", "generic type"]),
    ("ComprehensionBugs", 0.80, ["comprehension", "list comp", "dict comp", "generator"]),
    ("IteratorChain", 0.80, ["iterator", ".map(", ".filter(", ".fold(", "chain"]),
]
NO_FIX, NO_FIX_CATEGORY, UNKNOWN_FIX = 0.0, "NotDefect", ("Unknown", 0.70)

# Compiler codes and lints with their categories, confidences and classes.
CODE_CATEGORY = {
    "E0308": "Type Errors", "E0412": "Type Annotation Gaps", "E0502": "Ownership/Borrow", "E0503": "Ownership/Borrow",
    "E0505": "Ownership/Borrow", "E0382": "Memory Safety", "E0507": "Memory Safety", "E0277": "Trait Bounds",
    "E0425": "Stdlib Mapping", "E0433": "Stdlib Mapping", "E0599": "AST Transform", "E0615": "AST Transform",
    "E0614": "Operator Precedence", "E0658": "Configuration Errors",
}
LINT_CATEGORY = {
    "clippy::unwrap_used": "API Misuse", "clippy::expect_used": "API Misuse", "clippy::panic": "API Misuse",
    "clippy::todo": "Logic Errors", "clippy::unreachable": "Logic Errors", "clippy::cognitive_complexity": "Performance Issues",
    "clippy::too_many_arguments": "AST Transform", "clippy::match_single_binding": "AST Transform",
    "clippy::needless_collect": "Iterator Chain", "clippy::manual_map": "Comprehension Bugs",
}
CODE_CONFIDENCE = {
    "E0308": 0.95, "E0277": 0.95, "E0502": 0.95, "E0503": 0.95, "E0505": 0.95, "E0382": 0.90, "E0507": 0.90,
    "E0425": 0.85, "E0433": 0.85, "E0412": 0.85, "E0599": 0.80, "E0614": 0.80, "E0615": 0.80, "E0658": 0.75,
}
CODE_CLASS = {
    "E0308": "type", "E0412": "type", "E0502": "borrow", "E0503": "borrow", "E0505": "borrow", "E0382": "borrow",
    "E0507": "borrow", "E0425": "name", "E0433": "name", "E0277": "trait",
}
OTHER_CONFIDENCE, OTHER_CLASS = 0.70, "other"
