"""python -m mendframe."""
import sys

from mendframe.cli import main

if __name__ == "__main__":
    sys.exit(main())
