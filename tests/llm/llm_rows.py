"""What the tests of this folder share."""

from conftest_rows import hard_rows  # noqa: F401
from same import rows  # noqa: F401
