"""tillspark: retail back-office analytics as lazy Spark DataFrame operators.

Every public operator is a function ``DataFrame(s) + parameters -> DataFrame``
that performs no action; callers decide when to collect or write.
"""

from tillspark.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
