"""Analytics of agent trajectories and of training data on Spark."""

__all__ = ["HarnessOptions", "SetOptions", "TaskOptions", "load"]  # noqa: F822


def __getattr__(name: str):
    if name not in __all__:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from trailspark.plans import taskset  # not before it is asked for: Python workers import the package too

    return getattr(taskset, name)
