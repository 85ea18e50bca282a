from backlist.report import main

main()
