"""The 35 named questions about descriptions of agent programs, as algebra over a vocabulary.

A question is mostly a star: a class, properties its subjects must have, and optional ones. The two
namespaces are the caller's; detect() reads them off a graph.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.algebra import FALSE, TRUE, Call, Extend, Filter, Group, LeftJoin, Minus, Path, Select, Union, evaluate
from ..operators.graph import Pattern, Store, TripleStore, Var

#: Names that belong to the parent vocabulary; all others are the extension's.
PARENT = frozenset(
    "LLMAgent Task Prompt Tool Team Memory WorkflowPattern agentID agentRole agentPrompt taskPrompt performedByAgent promptInstruction promptContext promptOutputIndicator useLanguageModel hasAgentGoal hasAgentMember hasWorkflowStep stepOrder nextStep agentToolUsage StartStep EndStep WorkflowStep Goal LanguageModel Config Resource KnowledgeBase hasAgentConfig hasSystemConfig configKey configValue hasKnowledge hasWorkflowPattern hasAssociatedTask".split()
)


@dataclass(frozen=True)
class Vocabulary:
    parent: str = "urn:agents:parent#"
    extension: str = "urn:agents:extension#"

    def __call__(self, name: str) -> str:
        return T.iri((self.parent if name in PARENT else self.extension) + name)

    @property
    def namespaces(self) -> tuple[str, str]:
        return (self.parent, self.extension)


def detect(triples: DataFrame) -> Vocabulary:
    """The namespaces that the vocabulary's best-known names have in a graph."""
    name = T.local_name(F.col("p"))
    head = F.expr("substring(p, 2, length(p) - 2 - length(regexp_extract(p, '([^/#>]*)>$', 1)))")
    known = F.when(name.isin("agentID", "agentRole", "hasTitle", "containsAgent"), head)  # not a filter, which would be put before the count and cut a name out of every triple
    rows = triples.groupBy("p").count().groupBy(name.isin("agentID", "agentRole").alias("parent"), known.alias("ns")).agg(F.sum("count").alias("count"))
    best = {r.parent: r.ns for r in rows.orderBy("count", F.desc("ns")).collect() if r.ns is not None}  # a row for each namespace
    default = Vocabulary()
    return Vocabulary(best.get(True, default.parent), best.get(False, default.extension))


V = Var


def _star(v: Vocabulary, subject: str, kind: str | None, needed: dict[str, str], optional: dict[str, str] | None = None) -> Any:
    parts = [Pattern(V(subject), T.TYPE, v(kind))] if kind else []
    parts += [Pattern(V(subject), v(p), V(x)) for x, p in needed.items()]
    out: Any = Group(tuple(parts))
    for x, p in (optional or {}).items():
        out = LeftJoin(out, Group((Pattern(V(subject), v(p), V(x)),)))
    return out


def _on(v: Vocabulary, of: Any, subject: str, optional: dict[str, str]) -> Any:
    for x, p in optional.items():
        of = LeftJoin(of, Group((Pattern(V(subject), v(p), V(x)),)))
    return of


def _lit(text: str) -> str:
    return T.literal(text)


def _flags(of: Any, flags: dict[str, str]) -> Any:
    for name, x in flags.items():
        of = Extend(of, name, Call("if", (Call("bound", (V(x),)), _lit("yes"), _lit("no"))))
    return of


def _says(pattern: str, *xs: str) -> Call:
    return Call("regex", (Call("coalesce", (*[V(x) for x in xs], _lit(""))), _lit(pattern), _lit("i")))


def question(n: int, v: Vocabulary) -> Select:
    """Question n (1 to 35)."""
    owl_named = T.iri(T.OWL + "NamedIndividual")
    different = lambda of, x, *terms: of if not terms else different(Filter(of, Call("!=", (V(x), terms[0]))), x, *terms[1:])
    is_a = lambda x, kind: Call("exists", (Group((Pattern(V(x), T.TYPE, v(kind)),)),))
    agent = {"agent": "LLMAgent"}
    stars: dict[int, tuple[str, str | None, dict[str, str], dict[str, str], tuple[str, ...]]] = {
        # subject, class, needed, optional, order
        1: ("system", "AgenticSystem", {"agent": "containsAgent"}, {}, ("system", "agent")),
        2: ("agent", "LLMAgent", {}, {"id": "agentID", "role": "agentRole"}, ("agent",)),
        3: ("agent", "LLMAgent", {"type": "agentType"}, {}, ("agent",)),
        5: ("prompt", "Prompt", {"directive": "hasDirectiveFunction"}, {}, ("prompt",)),
        12: ("task", "Task", {"agent": "performedByAgent"}, {}, ("task",)),
        13: ("task", "Task", {"delegationStrategy": "hasDelegationStrategy"}, {}, ("task",)),
        14: ("task", None, {"predecessor": "dependsOn"}, {}, ("task",)),
        15: ("task", None, {"predecessor": "dependsOn"}, {"dependencyType": "hasDependencyType"}, ("task",)),
        16: ("task", "Task", {"expectedOutput": "hasExpectedOutput"}, {}, ("task",)),
        18: ("team", "Team", {"pattern": "employsCoordinationPattern"}, {}, ("team",)),
        19: ("team", "Team", {"member": "hasAgentMember"}, {}, ("team", "member")),
        20: ("team", "Team", {"pattern": "employsCoordinationPattern", "member": "hasAgentMember"}, {}, ("team", "pattern", "member")),
        24: ("step", "ConditionalStep", {}, {"edgeMapping": "hasEdgeMapping", "routingLogic": "hasRoutingLogic"}, ("step",)),
        25: ("agent", "LLMAgent", {}, {"reasoningEnabled": "hasReasoningEnabled"}, ("agent",)),
        27: ("agent", "LLMAgent", {"origin": "hasReasoningOrigin"}, {}, ("agent",)),
        29: ("memory", "Memory", {}, {"persistenceScope": "hasPersistenceScope"}, ("memory",)),
        31: ("tool", "Tool", {"inputSchema": "hasInputSchema"}, {}, ("tool",)),
        32: ("agent", None, {"tool": "agentToolUsage"}, {}, ("agent", "tool")),
        33: ("task", None, {"tool": "taskToolUsage"}, {}, ("task", "tool")),
    }
    if n in stars:
        subject, kind, needed, optional, order = stars[n]
        return Select(_star(v, subject, kind, needed, optional), (subject, *needed, *optional), tuple((o, False) for o in order))
    by = lambda *xs: tuple((x, False) for x in xs)
    if n == 4:
        own = Extend(_star(v, "agent", "LLMAgent", {"prompt": "agentPrompt"}), "promptKind", _lit("orchestration"))
        task = Extend(_star(v, "task", None, {"prompt": "taskPrompt", "agent": "performedByAgent"}), "promptKind", _lit("language-model"))
        return Select(Union(own, task), ("agent", "promptKind", "prompt"), by("agent", "promptKind"))
    if n == 6:
        parts = {"instruction": "promptInstruction", "context": "promptContext", "outputIndicator": "promptOutputIndicator"}
        return Select(_on(v, _star(v, "agent", "LLMAgent", {"prompt": "agentPrompt"}), "prompt", parts), ("agent", "prompt", *parts), by("agent"))
    if n == 7:
        flags = {"hasID": "id", "hasRole": "role", "hasLanguageModel": "lm", "hasPrompt": "prompt", "hasGoal": "goal"}
        optional = {"id": "agentID", "role": "agentRole", "lm": "useLanguageModel", "prompt": "agentPrompt", "goal": "hasAgentGoal"}
        return Select(_flags(_star(v, "agent", agent["agent"], {}, optional), flags), ("agent", *flags), by("agent"))
    if n == 8:
        flags = {"hasType": "type", "hasReasoningPattern": "reasoning", "hasMemoryBinding": "memory"}
        optional = {"type": "agentType", "reasoning": "employsReasoningPattern", "memory": "hasMemoryBinding"}
        return Select(_flags(_star(v, "agent", agent["agent"], {}, optional), flags), ("agent", *flags), by("agent"))
    if n in (9, 10):
        body = _star(v, "agent", "LLMAgent", {}, {"type": "agentType", "role": "agentRole"})
        human = _says("human|proxy", "type", "role")
        if n == 9:
            return Select(Extend(body, "isHumanProxy", Call("if", (human, TRUE, FALSE))), ("agent", "isHumanProxy"), by("agent"))
        known = Call("or", (Call("bound", (V("role"),)), Call("bound", (V("type"),))))
        rest = Call("if", (human, _lit("human-proxy"), Call("if", (known, _lit("worker"), _lit("unspecified")))))
        return Select(Extend(body, "classification", Call("if", (_says("manager|orchestrat|supervisor", "type", "role"), _lit("manager"), rest))), ("agent", "classification"), by("agent"))
    if n == 11:
        body = _star(v, "task", "Task", {}, {"description": "hasDescription"})
        told = Group((Path(V("task"), (((v("taskPrompt"),), False), ((v("promptInstruction"),), False)), V("instruction")),))
        return Select(LeftJoin(body, told), ("task", "description", "instruction"), by("task"))
    if n == 17:
        return Select(_on(v, _star(v, "task", None, {"schema": "hasOutputSchema"}), "schema", {"schemaDefinition": "hasSchemaDefinition"}), ("task", "schema", "schemaDefinition"), by("task"))
    if n in (21, 26):
        s, p, x, kind, general = ("team", "hasTerminationCondition", "condition", "conditionType", "TerminationCondition") if n == 21 else ("agent", "employsReasoningPattern", "pattern", "patternType", "ReasoningPattern")
        body = Group((Pattern(V(s), v(p), V(x)), Pattern(V(x), T.TYPE, V(kind))))
        return Select(different(body, kind, v(general), owl_named), (s, x, kind), by(s))
    if n == 22:
        path = Path(V("parent"), (((v("containsTeam"), v("orchestratesTeam")), True),), V("child"))
        return Select(Group((path, Pattern(V("child"), T.TYPE, v("Team")))), ("parent", "child"), by("parent", "child"))
    if n == 23:
        return Select(_on(v, _star(v, "pattern", "WorkflowPattern", {"step": "hasWorkflowStep"}), "step", {"order": "stepOrder", "nextStep": "nextStep"}), ("pattern", "step", "order", "nextStep"), by("pattern", "order"))
    if n == 28:
        body = Group((Pattern(V("owner"), v("hasMemoryBinding"), V("binding")), Pattern(V("binding"), v("bindsMemory"), V("memory"))))
        kind: Any = _lit("other")
        for label, name in (("system-wide", "AgenticSystem"), ("team-shared", "Team"), ("agent-private", "LLMAgent")):
            kind = Call("if", (is_a("owner", name), _lit(label), kind))
        return Select(Extend(_on(v, body, "binding", {"scope": "hasMemoryScope"}), "ownerKind", kind), ("owner", "ownerKind", "binding", "memory", "scope"), by("owner"))
    if n == 30:
        tools = Minus(Group((Pattern(V("tool"), T.TYPE, v("Tool")),)), Group((Pattern(V("tool"), T.TYPE, v("LLMAgent")),)))
        return Select(_on(v, tools, "tool", {"label": "hasTitle"}), ("tool", "label"), by("tool"))
    if n == 34:
        more = {"guardrailType": "hasGuardrailType", "validationLogic": "hasValidationLogic", "maxRetries": "hasMaxRetries"}
        return Select(_on(v, _star(v, "task", None, {"guardrail": "hasGuardrail"}), "guardrail", more), ("task", "guardrail", *more), by("task"))
    if n == 35:
        more = {"position": "hasCheckpointPosition", "checkpointType": "hasCheckpointType", "mandatory": "isMandatory"}
        return Select(_on(v, _star(v, "task", None, {"checkpoint": "hasHumanCheckpoint"}), "checkpoint", more), ("task", "checkpoint", *more), by("task"))
    raise ValueError("questions are numbered 1 to 35")


def run(n: int, graph: DataFrame | Store, vocabulary: Vocabulary | None = None, ordered: bool = True) -> DataFrame:
    """The rows of question n over triples (s, p, o) or a store, in the question's order unless any will do.

    Who asks several questions of one graph gives the vocabulary, which is read off the whole graph otherwise."""
    store = graph if isinstance(graph, Store) else TripleStore(graph.select("s", "p", "o").distinct())
    if vocabulary is None:
        vocabulary = detect(store.triples) if isinstance(store, TripleStore) else Vocabulary()
    asked = question(n, vocabulary)
    return evaluate(asked if ordered else replace(asked, order=()), store)
