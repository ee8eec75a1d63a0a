"""What the engine refuses, and why."""


class StudyError(ValueError):
    """The data or the declaration are not valid."""


class CapabilityError(NotImplementedError):
    """A well-posed question in a combination that is not available; raised before anything is fitted."""
