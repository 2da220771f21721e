"""Error codes, their classes and process exit codes. Rules yield rows with a code; only driver-side
actions that cannot go on raise ``FolioError``."""

from __future__ import annotations


class FolioError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


# Codes by class.
STRUCTURAL = (
    "unexpected-toc", "invalid-toc-hierarchy", "missing-chapter-title", "multiple-chapter-titles", "unexpected-chapter", "toc-chapter-mismatch",
    "heading-level-jump", "unclosed-paragraph", "missing-continuation", "continuation-without-source", "invalid-continuation-layout",
    "duplicate-footnote-label", "unresolved-footnote", "orphan-footnote", "figure-crop-unavailable", "toc-not-exhausted",
)
INFERENCE = (
    "context-budget-exceeded", "context-budget-indeterminate", "context-budget-probe-unavailable", "empty-response", "http-client-error", "http-retryable",
    "http-server-error", "invalid-completion-envelope", "invalid-http-response", "invalid-json", "invalid-structured-response",
    "output-token-limit", "response-body-truncated",
    "thinking-smoke-unavailable", "transport-error", "transport-timeout",
    "unexpected-reasoning-content",
)
EXTERNAL = ("epubcheck-failed", "pandoc-failed")
PROCESSING = (
    "config-drift", "duplicate-artifact-name", "inference-relocation-rejected", "invalid-commit-artifact-path", "invalid-run-layout", "output-transaction-corruption",
    "page-image-too-large", "page-render-failed", "render-environment-drift", "run-locked", "schema-drift", "source-hash-mismatch",
    "inference-environment-drift", "server-model-path-mismatch", "static-context-impossible", "thinking-control-contract-drift", "token-counting-calibration-failed",
    "token-counting-contract-drift", "unsupported-llama-server-contract", "unsupported-multi-model-server", "unsupported-thinking-control", "unverifiable-server-model-path", "unsupported-pandoc-defaults",
)
BAD_INPUT = ("invalid-artifact-path", "invalid-source-pdf")

_EXIT = ((INFERENCE, 10), (STRUCTURAL, 11), (EXTERNAL, 12), (PROCESSING, 13), (BAD_INPUT, 14))


def exit_code(code: str) -> int:
    """Exit code of the process that fails with ``code``; 1 for anything unknown."""
    return next((exit_ for codes, exit_ in _EXIT if code in codes), 1)
