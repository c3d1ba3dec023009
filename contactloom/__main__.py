from contactloom.cli import main

raise SystemExit(main())
