from dagtrail.plans.jobs import main

main()
