import sys

from vecflow.cli import main

sys.exit(main())
