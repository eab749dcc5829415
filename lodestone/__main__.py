from lodestone.commands import main

main()
