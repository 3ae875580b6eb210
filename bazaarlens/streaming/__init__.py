"""Every workload of this library is a batch job, so no streaming operator is provided.

Gap-based sessions (`bazaarlens.operators.analytics.sessionize`) count calendar-day
boundaries, which `session_window` (elapsed time) would not reproduce.
"""
