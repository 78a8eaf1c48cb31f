"""Independent SQL for the checks: the same results, written for another engine."""
