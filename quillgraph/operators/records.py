"""Schemas of the records that lifting reads and lowering returns: one DataFrame each."""

from __future__ import annotations

CONDITION = "struct<type:string,trigger:string,max_turns:int,operator:string,conditions:array<struct<type:string,trigger:string,max_turns:int>>>"

SCHEMAS = {
    "systems": "system_id string, name string, framework string, namespace string",
    "agents": "system_id string, agent_key string, role string, goal string, backstory string, llm string, tools array<string>, reasoning boolean, max_reasoning_attempts int, memory boolean, verbose boolean, allow_delegation boolean, knowledge_sources array<string>, agent_type string, description string, directive_function string, reasoning_origin string, reasoning_pattern string, memory_type string, memory_persistence string, human_input boolean, prompt_source string, source_file string",
    "tasks": "system_id string, task_key string, description string, expected_output string, agent_key string, tools array<string>, context_tasks array<string>, output_pydantic string, output_json string, human_input boolean, guardrails array<string>, guardrail_max_retries int, delegation_strategy string, source_attribute string, source_file string",
    "tools": "system_id string, tool_key string, class_name string, name string, description string, args_schema_json string, implementation_ref string, source_file string",
    "teams": f"system_id string, team_key string, team_class_name string, agent_keys array<string>, task_keys array<string>, process string, verbose boolean, memory boolean, manager_llm string, manager_agent string, max_turns int, knowledge_sources array<string>, coordination_pattern string, termination_conditions array<{CONDITION}>, source_file string",
    "flows": "system_id string, class_name string, state_model string, crew_references array<string>, state_fields map<string,string>, source_file string",
    "flow_steps": "system_id string, flow string, ord int, method_name string, step_type string, dependencies array<string>, calls_crew string, return_values array<string>, function_body string, associated_agent_key string, edge_mapping map<string,string>, aggregation_combinator string, outgoing array<string>",
    "models": "system_id string, class_name string, schema_json string, source_file string",
}
