from cartlens.plans.pipeline import main

main()
