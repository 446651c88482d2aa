"""Record types of tasks, traces and training samples."""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"
CALL = "struct<tool:string,id:string,params:map<string,string>>"
RESULT = "struct<success:boolean,stdout:string,stderr:string,exit_code:int,timed_out:boolean,outcome:string>"
TARGET = "struct<candidate_call_id:string,sampled_prediction:string,actual:string,decision:string,shadow:boolean,candidate_sha256:string,context_turns:int>"
TASK = "task_id long, text string, code string, test_list array<string>, test_setup_code string"
SAMPLE = "token_ids array<int>, mask array<boolean>, logprobs array<double>, temperatures array<double>, env_name string, rl_weights array<double>, ce_weights array<double>"
ASSIGNMENT = "task_id long, case_id string, trace_type string, candidate_outcome string, recovery_mode string"

# The label set, decisions, tools and recovery modes of the trace format.
OUTCOMES = ("PASS", "ASSERTION_FAILURE", "RUNTIME_ERROR", "SYNTAX_ERROR", "TIMEOUT", "OTHER")
DECISIONS = ("KEEP", "REVISE")
TOOLS = ("read_file", "apply_patch", "python_test")
MODES = ("shadow", "visible", "deep_shadow", "deep_visible")
