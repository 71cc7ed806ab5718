from strandweave.plans.cli import main

main()
