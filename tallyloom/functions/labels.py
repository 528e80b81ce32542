"""Fixed values of the operation vocabulary."""

VALIDATION = ("run_tests", "build", "lint", "git_diff_check")
REPOSITORY = ("git_status", "git_diff_check", "git_diff_names", "git_diff_stat", "git_log")
CI = ("github_pr_checks", "github_ci_status")
#: Labels whose successful output may be replaced by a status summary.
STATUS_OUTPUT = VALIDATION + CI
#: Labels that can be part of a workflow episode; any other one is a content boundary.
WORKFLOW = tuple(dict.fromkeys(VALIDATION + REPOSITORY + CI))
#: Labels whose identical results may be reused.
READ_ONLY = ("read_file", "find_related_files", "search_text", "git_status", "git_log", "git_diff_patch", "git_diff_names", "git_diff_stat")

#: Families that consist of one action each; the others are workflow bundles.
SINGLE_FAMILIES = ("validation_output", "await_completion", "reuse_results")
TITLES = {
    "reuse_results": "reuse_unchanged_results",
    "await_completion": "await_process_completion",
    "validation_report": "validate_and_report",
    "validation_output": "summarize_validation_results",
    "ci_report": "collect_ci_status",
    "repository_report": "summarize_repository_state",
}
OPPORTUNITY = {"reuse_results": "result_reuse", "await_completion": "polling_reducer", "validation_output": "result_reducer"}
BUNDLE = "workflow_bundle"
MECHANISMS = ("validation_status", "empty_poll", "unchanged_result")
#: Model turns within which an identical result may be reused, keys that a session remembers, and the least a reference costs.
REUSE_TURNS, REUSE_KEYS, REUSE_FLOOR = 5, 64, 200
