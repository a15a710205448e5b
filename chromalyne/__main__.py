import sys

from chromalyne.cli import main

sys.exit(main())
