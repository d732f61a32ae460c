"""``python -m millrace NAME``: run a registered app."""

import sys

from millrace.plans import examples  # noqa: F401
from millrace.plans.pipeline import main

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
